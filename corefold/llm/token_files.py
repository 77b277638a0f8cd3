"""Token ids in files, bit-packed at the fixed width that the vocabulary needs.

A file, all integers little-endian:

    "CFTK" 0x01, bits (1 byte), block length in ids (4 bytes)
    blocks: each id in ``bits`` bits, lowest bit first; a block ends at a whole byte
    8 bytes for each block: where it starts
    16 bytes for each document: its id (or -2**63 for null) and its first id's place in the file
    trailer of 32 bytes: blocks, documents, ids, place of the block offsets

Files of one corpus are numbered; in ascending order they hold the documents in ascending
order. Any block, and so any id or document, can be read on its own, and a block is unpacked
by numpy without a loop over ids.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, shuffle_partitions
from .tokenizing import encoder

MAGIC = b"CFTK\x01"
HEAD, TRAILER = struct.Struct("<5sBI"), struct.Struct("<4q")
BLOCK = 8192
NULL = -(1 << 63)
#: Reading tasks; with more ranges than that a task has several.
MOST_TASKS = 10_000
#: Rows that the files' ranges are found on, at most.
MOST_SAMPLED = 200_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype("<u4")


class Writer:
    """Blocks go out as they fill; only the index, 16 bytes a document and 8 a block, stays in memory."""

    def __init__(self, out, bits: int, block: int = BLOCK):  # noqa: ANN001
        self.out, self.bits, self.block = out, bits, block
        self.at = out.write(HEAD.pack(MAGIC, bits, block)) or HEAD.size
        self.blocks, self.docs = array("q"), array("q")
        self.n, self.rest = 0, np.zeros(0, "<u4")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.extend((NULL if doc_id is None else doc_id, self.n))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block
        for k in range(0, whole, self.block):
            self._put(ids[k : k + self.block])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.out.write(np.asarray(self.blocks, "<i8").tobytes())
        self.out.write(np.asarray(self.docs, "<i8").tobytes())
        self.out.write(TRAILER.pack(len(self.blocks), len(self.docs) // 2, self.n, self.at))


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, source):  # noqa: ANN001
        self.source = source
        magic, self.bits, self.block = HEAD.unpack(source.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        size = source.size()
        blocks, docs, self.n, at = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        self.offsets = np.frombuffer(source.read_at(8 * blocks, at), "<i8").tolist() + [at]
        self.docs = np.frombuffer(source.read_at(16 * docs, at + 8 * blocks), "<i8").reshape(-1, 2)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(self.offsets[last + 1] - self.offsets[first], self.offsets[first])
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            out.append(unpack_bits(data[self.offsets[b] - self.offsets[first] : self.offsets[b + 1] - self.offsets[first]], self.bits, n))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def documents(self, ids_at_once: int = 1 << 20, first: int = 0, stop: int | None = None) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, place of its first id, ids, their crc32), the ids read some blocks at a time: of documents that begin in ``first <= place < stop``."""
        a, b = np.searchsorted(self.docs[:, 1], [first, self.n if stop is None else stop]).tolist()
        starts = self.docs[a : b + 1, 1].tolist() + ([self.n] if b == len(self.docs) else [])
        lo, hi, held = 0, 0, np.zeros(0, "<u4")
        for doc, start, end in zip(self.docs[a:b, 0].tolist(), starts, starts[1:], strict=False):
            crc, at = 0, start
            while at < end:
                if at >= hi:
                    lo, hi = at, min(self.n, at + ids_at_once)
                    held = self.ids(lo, hi)
                stop = min(end, hi)
                crc = zlib.crc32(held[at - lo : stop - lo].tobytes(), crc)
                at = stop
            yield None if doc == NULL else doc, start, end - start, crc


def _file(folder: str, k: int) -> str:
    return f"{folder}/part-{k:06d}.tok"


Place = tuple[bool, int, int]


def _place(doc_id: int | None, h: int) -> Place:
    """What documents are ordered by: null ids first, then the id, then the text's hash."""
    return doc_id is not None, doc_id or 0, h


def bounds(rows: DataFrame, files: int) -> list[Place]:
    """Where each file but the first begins: quantiles of a bounded sample of ``doc_id, h``, the same ones every time."""
    some = bounded_sample(rows, ["doc_id", "h"], min(MOST_SAMPLED, 64 * files), rows.count()).collect()
    places = sorted(_place(r["doc_id"], r["h"]) for r in some)
    return [places[len(places) * k // files] for k in range(1, files)] if places else []


def encoded(docs: DataFrame, path: str, end_id: int, begins: list[Place]) -> DataFrame:
    """``file, doc_id, h, ids``: each text's ids and ``end_id``, in two or four bytes each as the vocabulary needs, and the file where they belong."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, "bytes"), np.asarray([end_id], "<u4").tobytes()
        narrow = _width(enc, end_id) == 2
        for b in batches:
            ids = (enc.ids(text.as_py()) + end for text in b.column(1))
            if narrow:
                ids = (np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids)
            files = [bisect_right(begins, _place(d, h)) for d, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), b.column(0), b.column(2), pa.array(ids, pa.binary())], ["file", "doc_id", "h", "ids"])

    return docs.select("doc_id", "text", "h").mapInArrow(run, "file int, doc_id long, h long, ids binary")


def _width(enc, end_id: int) -> int:  # noqa: ANN001
    return 2 if bits_for(max(enc.tokenizer.get_vocab_size(), end_id + 1)) <= 16 else 4


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> DataFrame:
    """Write ``doc_id, text`` in ascending order of ids, null first; a row a file: ``file, n_docs, n_tokens``.

    Texts are encoded where they are read, once, and only packed ids are dealt. That goes by
    range of (doc_id, hash of the text), found on a bounded sample beforehand, so not even a
    repeated id gathers in one task, and those that tie come in the hash's order. A null text counts as empty, repeated rows are documents
    of their own, other columns are left out, and an empty table gives files without
    documents. A task writes beside the final name and then renames, so a lost or repeated
    task leaves whole files only. ``folder`` is a URI that pyarrow's file systems open.
    """
    spark = docs.sparkSession
    pafs_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        bits = bits_for(max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1))
        task, kind = TaskContext.get(), "<u2" if bits <= 16 else "<u4"
        k, where = task.partitionId(), f".{task.stageId()}-{task.taskAttemptId()}"
        store, final = pafs.FileSystem.from_uri(_file(folder, k))
        with store.open_output_stream(final + where) as out:
            w = Writer(out, bits)
            for b in batches:
                for doc, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    w.add(doc, np.frombuffer(ids.as_buffer(), kind))
            w.close()
        if store.get_file_info(final).type != pafs.FileType.NotFound:
            store.delete_file(final)
        store.move(final + where, final)
        yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "n_docs": [len(w.docs) // 2], "n_tokens": [w.n]})

    files, text = shuffle_partitions(spark), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = encoded(rows, path, end_id, bounds(rows.select("doc_id", "h"), files)).repartitionById(files, F.col("file"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    return ordered.select("doc_id", "ids").mapInArrow(run, "file int, n_docs long, n_tokens long")


def pafs_folder(folder: str) -> None:
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, int]], *, split_ids: int = 16 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts over all files.

    ``files`` has the number and the ids of each file: a row a task of the writing, not a row
    a document. A file is read by as many tasks as it has ranges of ``split_ids`` ids, made
    on the executors; a task owns the documents that begin in its range.
    """
    base, rows = 0, []
    for k, n in sorted(files):
        if n:
            rows.append((k, n, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, base, lo in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                store, path = pafs.FileSystem.from_uri(_file(folder, k))
                with store.open_input_file(path) as source:
                    got: list[tuple] = []
                    reader = Reader(source)
                    for doc, start, n, crc in reader.documents(first=lo, stop=min(lo + split_ids, reader.n)):
                        got.append((doc, base + start, n, crc))
                        if len(got) == 10_000:
                            yield _rows(got)
                            got = []
                    yield _rows(got)

    listed = spark.createDataFrame(rows, "file int, n long, base long")
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(split_ids).cast("long")))
    tasks = sum(-(-n // split_ids) for _, n, _ in rows)
    listed = listed.select("file", "base", lows.alias("lo")).repartition(max(1, min(tasks, MOST_TASKS)), "file", "lo")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(got: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.int64()) for i in range(4)], names)
