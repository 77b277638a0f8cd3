"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into shards by a
hash, whatever their source, and a shard is packed as a multiset of lengths: at most
``capacity`` counts, however many pieces it has. Each shard's population lives on several
islands. A generation takes two parents, injects well-filled bins of one whole into the
other, dissolves the bins there whose items are now used twice, the emptiest first, and
places the displaced items by best fit. Between epochs each island's elite migrates to the
next one of the ring. A shard whose best fit has as few bins as any packing can have is
done at once. The best solution of a shard is handed out to its pieces by rank within
(shard, length), so nothing is ever gathered beyond one shard's bins; pieces of the full
length have a sequence to themselves and take no part in any of this.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, spread
from .tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "shard int, island int, n_bins int, lengths binary, sizes binary"


def tokenise(df: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of ``doc_id, text``: ids of the whole text and ``end_id``, cut at every ``capacity`` ids.

    A null or empty text gives one piece, of the end id. ``with_ids`` adds the ids themselves.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, "words"), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


Bins = list[tuple[int, ...]]


class Packer:
    """The genetic algorithm over one shard: ``counts`` has the number of items of each length."""

    #: Bins of the donor that are injected, of all, and bins that mutation dissolves beside, at most.
    INJECTED, DISSOLVED = 0.3, 0.2

    def __init__(self, counts: dict[int, int], capacity: int, seed: int):
        self.counts, self.capacity, self.random = counts, capacity, random.Random(seed)
        total = sum(n * c for n, c in counts.items())
        halves = sum(c for n, c in counts.items() if 2 * n > capacity)
        self.least = max(-(-total // capacity), halves)  # no packing has fewer bins

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """Place ``items``, longest first, each where the least room remains that holds it."""
        cap = self.capacity
        room: list[list[int]] = [[] for _ in range(cap + 1)]
        mask = 0
        for i, b in enumerate(bins):
            if left := cap - sum(b):
                room[left].append(i)
                mask |= 1 << left
        for n in sorted(items, reverse=True):
            if fits := mask >> n:
                left = n + (fits & -fits).bit_length() - 1
                i = room[left].pop()
                if not room[left]:
                    mask ^= 1 << left
                bins[i] = (*bins[i], n)
            else:
                left, i = cap, len(bins)
                bins.append((n,))
            if left := left - n:
                room[left].append(i)
                mask |= 1 << left
        return bins

    def fitness(self, bins: Bins) -> tuple:
        """Fewer bins first, then the mean square of how full they are."""
        return -len(bins), sum(sum(b) ** 2 for b in bins) / max(len(bins), 1)

    def first(self) -> Bins:
        return self.best_fit([], [n for n, c in self.counts.items() for _ in range(c)])

    def varied(self) -> Bins:
        """A start from random bins: a random tenth of the items in random order, then best fit."""
        items = [n for n, c in self.counts.items() for _ in range(c)]
        self.random.shuffle(items)
        bins: Bins = []
        k = len(items) // 10
        for n in items[:k]:
            if bins and sum(bins[-1]) + n <= self.capacity:
                bins[-1] = (*bins[-1], n)
            else:
                bins.append((n,))
        return self.best_fit(bins, items[k:])

    def cross(self, a: Bins, b: Bins) -> Bins:
        """A child of ``a`` with bins from the fuller half of ``b``."""
        top = sorted(b, key=sum, reverse=True)[: max(1, len(b) // 2)]
        injected = self.random.sample(top, max(1, min(len(top), int(len(b) * self.INJECTED))))
        twice = Counter(n for x in injected for n in x)
        left = sum(twice.values())
        dissolved = int(len(a) * self.DISSOLVED * self.random.random())
        child, displaced = [], []
        for k, x in enumerate(sorted(a, key=sum)):
            if k >= dissolved and not (left and any(twice[n] for n in x)):
                child.append(x)
                continue
            for n in x:
                if twice[n]:
                    twice[n] -= 1
                    left -= 1
                else:
                    displaced.append(n)
        return self.best_fit(child + injected, displaced)

    def evolve(self, start: list[Bins], size: int, generations: int, patience: int = 15) -> Bins:
        """The best of a population of ``size`` after ``generations``, or once ``patience`` of them in a row have spared no bin."""
        people = list(start)
        if not people:
            people.append(self.first())
        if len(min(people, key=len)) > self.least:
            while len(people) < size:
                people.append(self.varied())
            since, fewest = 0, min(map(len, people))
            for _ in range(generations):
                a, b = self.random.sample(range(len(people)), 2)
                people.append(self.cross(people[a], people[b]))
                people.sort(key=self.fitness, reverse=True)
                del people[size:]
                since = since + 1 if len(people[0]) >= fewest else 0
                fewest = len(people[0])
                if fewest <= self.least or since >= patience:
                    break
        return max(people, key=self.fitness)


def _frozen(bins: Bins) -> tuple[int, bytes, bytes]:
    return len(bins), np.asarray([n for b in bins for n in b], "<u4").tobytes(), np.asarray([len(b) for b in bins], "<u4").tobytes()


def _thawed(lengths: bytes | None, sizes: bytes | None) -> list[Bins]:
    if lengths is None or sizes is None:
        return []
    ends = np.cumsum(np.frombuffer(sizes, "<u4"))
    items = np.frombuffer(lengths, "<u4").tolist()
    return [[tuple(items[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]] if len(ends) else [[]]


def pack(
    pieces: DataFrame, key: tuple[str, ...], capacity: int, *, shard_items: int = 60_000, islands: int = 3, epochs: int = 3,
    population: int = 8, generations: int = 60,
) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces``, which have ``length`` from 1 to ``capacity``.

    ``key`` names columns that tell pieces apart; rows that agree in all of them are
    interchangeable, and each gets a place of its own. ``deal``, if there is such a column,
    is a number by which pieces are dealt into shards, so that not even rows that agree in
    all else meet in one; else a hash of ``key`` does. Sequences hold no more than
    ``capacity`` tokens and their offsets are gapless from 0. Pieces of the full length
    have a sequence to themselves, with a negative number, and are neither dealt nor ranked.
    An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c != "deal"]
    short = pieces.where(F.col("length") < capacity)
    n = short.count()
    shards = max(1, -(-n // shard_items))
    number = F.xxhash64("deal") if "deal" in pieces.columns else F.xxhash64(*key)
    dealt = short.withColumn("shard", F.pmod(number, F.lit(shards)).cast("int"))
    lengths = dealt.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("c"))
    hist = lengths.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("length", "c"))).alias("hist"))
    hist = materialise(hist, "lengths")

    def epoch(e: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    counts = {x["length"]: x["c"] for x in r["hist"]}
                    p = Packer(counts, capacity, 1_000_003 * r["shard"] + 1009 * r["island"] + e)
                    best = p.evolve(_thawed(r["lengths"], r["sizes"]) + _thawed(r["m_lengths"], r["m_sizes"]), population, generations)
                    row = {"shard": r["shard"], "island": r["island"]} | dict(zip(("n_bins", "lengths", "sizes"), _frozen(best), strict=True))
                    schema = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("n_bins", pa.int32()), ("lengths", pa.binary()), ("sizes", pa.binary())])
                    yield pa.RecordBatch.from_pylist([row], schema)

        return run

    ring = Window.partitionBy("shard").orderBy("island")
    none = [F.lit(None).cast("binary").alias(c) for c in ("lengths", "sizes", "m_lengths", "m_sizes")]
    state = hist.select("shard", "hist", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).select("shard", "island", "hist", *none)
    for e in range(epochs):
        if e:  # the elite of the island before, round the ring
            whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            for c in ("lengths", "sizes"):
                state = state.withColumn(f"m_{c}", F.coalesce(F.lag(c).over(ring), F.last(c).over(whole)))
            state = state.join(hist, "shard").select("shard", "island", "hist", "lengths", "sizes", "m_lengths", "m_sizes")
        state = materialise(state.repartition(max(1, min(shards * islands, 4096)), "shard", "island").mapInArrow(epoch(e), _STATE), "elites")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes, items = np.frombuffer(r["sizes"], "<u4").astype("i8"), np.frombuffer(r["lengths"], "<u4").astype("i8")
                seq = np.repeat(np.arange(len(sizes)), sizes)
                upto = np.cumsum(items) - items
                first = np.repeat((np.cumsum(sizes) - sizes), sizes)
                offset = upto - upto[first] if len(items) else upto
                order = np.argsort(items, kind="stable")
                rank = np.empty(len(items), "i8")
                ordered = items[order]
                start = np.searchsorted(ordered, ordered)
                rank[order] = np.arange(len(items)) - start
                shard = np.full(len(items), r["shard"], "i4")
                names = ["p_shard", "p_length", "p_rank", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, items, rank, (shard.astype("i8") << 32) + seq, offset)], names)

    best = state.withColumn("__r", F.row_number().over(Window.partitionBy("shard").orderBy("n_bins", "island"))).where("__r = 1")
    slots = best.select("shard", "lengths", "sizes").mapInArrow(places, "p_shard int, p_length long, p_rank long, sequence_id long, offset long")
    spark_rank = F.row_number().over(Window.partitionBy("shard", "length").orderBy(*[F.col(k).asc_nulls_first() for k in key])) - 1
    ranked = dealt.withColumn("__rank", spark_rank.cast("long"))
    on = (F.col("shard") == F.col("p_shard")) & (F.col("length") == F.col("p_length")) & (F.col("__rank") == F.col("p_rank"))
    alone = (-1 - F.monotonically_increasing_id()).alias("sequence_id")
    whole = pieces.where(F.col("length") == capacity).select(*columns, alone, F.lit(0).cast("long").alias("offset"))
    return ranked.join(slots, on).select(*columns, "sequence_id", "offset").unionByName(whole)


def pack_documents(df: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of every document with the sequence and the offset where each lies.

    Null ids, repeated rows and extra columns are fine: pieces that agree in all their
    columns are interchangeable. The token pieces are written to the shared folder once, so
    a lost executor never costs a second tokenising of the corpus.
    """
    pieces = materialise(spread(tokenise(df, path, end_id, capacity)).withColumn("deal", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, ("doc_id", "piece", "start", "ids_crc32"), capacity)
