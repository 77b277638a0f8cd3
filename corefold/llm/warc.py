"""WARC archives: written with revisit records, read back by byte range.

A record is a gzip member of its own. A reading task has a range of a file: it looks for the
bytes that a member begins with, takes a place for a record only if what unpacks there begins
as a WARC header does, and owns the records that begin inside its range, whose rest it reads
from beyond. So a file of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

MAGIC = b"\x1f\x8b\x08"
BEGINS = b"WARC/1."
CHUNK = 1 << 18
#: Payloads that occur more than once, up to which they are broadcast; about 50 bytes each.
BROADCAST_PAYLOADS = 200_000
#: Reading tasks; with more ranges than that a task has several.
MOST_TASKS = 10_000
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One gzip member. A revisit has the headers of its payload and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest32(payload)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, url, html, revisit, refers_to``: the smallest page_id of a payload is its response.

    Only payloads that occur more than once are joined back, and a page is no larger for it.
    Rows that repeat the smallest id of their payload are responses all; a null id is a
    revisit where the payload has any id, else a response. Payloads of under ``least_bytes``
    bytes are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    again = materialise(again.where("n > 1 and first is not null").select(F.col("sha").alias("again"), "first"), "payloads")
    if again.count() <= BROADCAST_PAYLOADS:
        again = F.broadcast(again)
    joined = rows.join(again, F.col("sha") == F.col("again"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def _file(folder: str, k: int) -> str:
    return f"{folder}/part-{k:06d}.warc.gz"


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``page_id, url, html`` as archives; a row a file: ``file, size, records``.

    A null html is an empty payload, a null address leaves its header out; repeated rows each
    give a record; other columns are left out; an empty table gives files without records.
    Each task writes one file beside its final name and renames it, so that a lost or
    repeated task leaves whole files only.
    """
    bounded_batches(pages.sparkSession)
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k, where = task.partitionId(), f".{task.stageId()}-{task.taskAttemptId()}"
        store, final = pafs.FileSystem.from_uri(_file(folder, k))
        size = n = 0
        with store.open_output_stream(final + where) as out:
            for b in batches:
                for page, url, html, revisit, refers in zip(*[b.column(i) for i in range(5)], strict=True):
                    data = record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py(), revisit.as_py(), date)
                    out.write(data)
                    size, n = size + len(data), n + 1
        if store.get_file_info(final).type != pafs.FileType.NotFound:
            store.delete_file(final)
        store.move(final + where, final)
        yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int32()), "size": [size], "records": [n]})

    return with_revisits(pages, least_bytes).mapInArrow(run, "file int, size long, records long")


class RangeReader:
    """The records that begin in ``lo <= offset < hi`` of an open file."""

    def __init__(self, source, lo: int, hi: int):  # noqa: ANN001
        self.source, self.lo, self.size = source, lo, source.size()
        self.hi = min(hi, self.size)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the member at ``at`` unpacks to, and where it ends; None if no record begins there."""
        pack, out, seen, pos = zlib.decompressobj(31), [], b"", at
        try:
            while not pack.eof and pos < self.size:
                data = self.source.read_at(min(CHUNK, self.size - pos), pos)
                pos += len(data)
                got = pack.decompress(data)
                if len(seen) < len(BEGINS):
                    seen += got[: len(BEGINS)]
                    if not BEGINS.startswith(seen[: len(BEGINS)]):
                        return None
                out.append(got)
        except zlib.error:
            return None
        if not pack.eof or not seen.startswith(BEGINS):
            return None
        return b"".join(out), pos - len(pack.unused_data)

    def __iter__(self) -> Iterator[bytes]:
        at = self.lo
        while at < self.hi:
            window = self.source.read_at(min(CHUNK, self.size - at), at)
            k = window.find(MAGIC)
            if k < 0:  # the last bytes may begin a member that goes on beyond the window
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            if at + k >= self.hi:
                return
            got = self.member(at + k)
            if got is None:
                at += k + 1
            else:
                yield got[0]
                at = got[1]


def parse(data: bytes) -> dict:
    """A record's fields: headers in lower case, and ``payload``, None for a revisit."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {}
    for x in head.decode().split("\r\n")[1:]:
        name, _, value = x.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for x in http.decode().split("\r\n")[1:]:
        name, _, value = x.partition(":")
        fields[f"http-{name.strip().lower()}"] = value.strip()
    fields["payload"] = None if fields["warc-type"] == "revisit" else payload
    return fields


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def read_archives(spark: SparkSession, folder: str, files: list[tuple[int, int]], *, split_bytes: int = 32 << 20) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload`` of all records.

    ``files``: number and size of each, a row a writing task; their byte ranges are made on
    the executors. A response's length and digest are taken from the payload that was read,
    and have to equal its headers; a revisit's are its headers. No files, or empty ones, give
    an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for k, lo, hi in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                store, path = pafs.FileSystem.from_uri(_file(folder, k))
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(path) as source:
                    for data in RangeReader(source, lo, hi):
                        x = parse(data)
                        body, digest, n = x["payload"], x["warc-payload-digest"].removeprefix("sha1:"), int(x["http-content-length"])
                        if body is not None and (len(body) != n or digest32(body) != digest):
                            raise ValueError(f"{path}: the record of {x['warc-record-id']} isn't what was written")
                        refers = _page(x["warc-refers-to"]) if "warc-refers-to" in x else None
                        rows.append((_page(x["warc-record-id"]), x.get("warc-target-uri"), x["warc-type"], n, digest, refers, body))
                        held += len(body or b"")
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    listed = spark.createDataFrame([(k, size) for k, size in files if size], "file int, size long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    listed = listed.select("file", starts.alias("lo")).withColumn("hi", F.col("lo") + split_bytes)
    n = sum(-(-size // split_bytes) for _, size in files)
    listed = listed.repartition(max(1, min(n, MOST_TASKS)), "file", "lo")
    return listed.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
