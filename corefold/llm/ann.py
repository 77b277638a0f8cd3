"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised on their own, by k-means fitted on a bounded
sample; a vector's cell is its pair of centroids, and every vector is indexed. A search walks
the cells in ascending order of the summed squared distance of its own halves to the two
centroids, by a heap over the pairs, until the cells hold enough entries, and ranks these by
exact distance. How many are enough is measured: true neighbours of a bounded sample of
vectors are found by brute force, and the walk is as long as it has to be to meet the wanted
share of them.

Equal vectors are one entry with their smallest ids, as many as a result can hold, so a
vector that a third of the rows share costs no more than another. Entries are dealt into
blocks by their first centroid, each written once; a task holds one block and the searches
that visit it stream by, each giving its nearest there. Only a block that very many searches
visit is copied.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, materialise, shuffle_partitions

#: Vectors that the centroids are fitted on, and that the length of the walk is measured on, at most.
FIT_SAMPLE, WALK_SAMPLE = 20_000, 64
#: Most centroids for a half; the counts by cell that the driver and each task hold are their square.
MOST_CENTROIDS = 256
#: Bytes of entries that a task holds, and searches that one copy of a block meets.
BLOCK_BYTES, BLOCK_SEARCHES = 32 << 20, 65_536
#: Searches up to which their results are broadcast to the rows that asked; a kilobyte each.
BROADCAST_SEARCHES = 20_000


@dataclass
class Index:
    """Centroids of both halves, entries by cell, and how many entries a search has to see."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    enough: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest_centroid(x[:, :h], self.first) * len(self.second) + nearest_centroid(x[:, h:], self.second)

    def walk(self, q: np.ndarray, enough: int | None = None) -> list[int]:
        """Cells in ascending order of summed distance, until they hold ``enough`` entries."""
        enough = self.enough if enough is None else enough
        h = self.first.shape[1]
        da, db = ((self.first - q[:h]) ** 2).sum(axis=1), ((self.second - q[h:]) ** 2).sum(axis=1)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        da, db = da[oa].tolist(), db[ob].tolist()
        oa, ob = oa.tolist(), ob.tolist()
        heap, out, held = [(da[0] + db[0], 0, 0)], [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * len(ob) + ob[j]
            if n := int(self.counts[cell]):
                out.append(cell)
                held += n
            # every pair is reached once: along the second half, and from its head to the next of the first
            if j + 1 < len(ob):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
    return d.argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest_centroid(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, v`` of vectors that take part, and their length: the commonest one, the greater if two are.

    Of rows that repeat an id the one with the smallest vector takes part, component by component.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0]["dim"] if common else 0
    rows = rows.where(F.size("v") == dim)
    again = materialise(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")  # ids only are shuffled
    if again.limit(1).count():
        once = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = rows.join(again, "vec_id", "left_anti").unionByName(once)
    return rows, dim


def _brute(batches: Iterator[pa.RecordBatch], queries: np.ndarray, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The best ``k + 1`` entries of a task for each of a few vectors."""
    best: list[list[tuple[float, int]]] = [[] for _ in queries]
    for b in batches:
        x, ids = _matrix(b.column(1), dim), b.column(0).to_pylist()
        for i, q in enumerate(queries):
            d = _distances(x, q)
            near = np.argsort(d, kind="stable")[: k + 1]
            best[i] = sorted(best[i] + [(float(d[n]), ids[n]) for n in near])[: k + 1]
    rows = [(i, e, d) for i, found in enumerate(best) for d, e in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["q", "entry", "d"])


def build(entries: DataFrame, dim: int, n: int, k: int, recall: float, entries_per_cell: int) -> Index:
    """Fit, count and measure. What comes to the driver is bounded by the parameters above."""
    h = dim // 2
    sample = bounded_sample(entries.select("entry", "v"), ["entry"], FIT_SAMPLE, n).toArrow()
    x = _matrix(sample["v"].combine_chunks(), dim)
    c = int(np.clip(round((n / entries_per_cell) ** 0.5), 1, MOST_CENTROIDS))
    index = Index(kmeans(x[:, :h], c), kmeans(x[:, h:], c), np.zeros(0, np.int64), 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index.cells(_matrix(b.column(0), dim)), pa.int64())], ["cell"])

    counts = entries.select("v").mapInArrow(assign, "cell long").groupBy("cell").count().collect()
    index.counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in counts:
        index.counts[r["cell"]] = r["count"]
    queries = x[:WALK_SAMPLE]
    ids = sample["entry"].to_pylist()[:WALK_SAMPLE]
    rows = entries.select("entry", "v").mapInArrow(lambda it: _brute(it, queries, k, dim), "q long, entry long, d double").collect()
    found: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        if r["entry"] != ids[r["q"]]:
            found.setdefault(r["q"], []).append((r["d"], r["entry"]))
    true = {q: [e for _, e in sorted(got)[:k]] for q, got in found.items()}
    wanted = sorted({e for got in true.values() for e in got})
    where: dict[int, int] = {}
    for r in entries.where(F.col("entry").isin(wanted)).select("entry", "v").collect() if wanted else []:
        where[r["entry"]] = int(index.cells(np.asarray([r["v"]], np.float64))[0])
    needed = []
    for q, got in true.items():
        at, seen = {}, 0
        for cell in index.walk(queries[q], n + 1):
            seen += int(index.counts[cell])
            at[cell] = seen
        needed += [at[where[e]] for e in got]
    index.enough = int(min(n, 1.15 * np.quantile(needed, recall))) + 1 if needed else n
    return index


def _rerank(batches: Iterator[pa.RecordBatch], wide: int, dim: int, most: int) -> Iterator[pa.RecordBatch]:
    """The nearest entries of a block for each search that visits it. Rows come block by block, its entries before its searches."""
    key, held = None, []
    x, second, ids = np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        places = np.stack([b.column(c).to_numpy() for c in range(4)])
        cuts = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part, here, side = b.slice(lo, hi - lo), tuple(places[:3, lo].tolist()), places[3, lo]
            if here != key:
                key, held = here, []
                x = x[:0]
            if side == 0:
                held.append((_matrix(part.column(7), dim), part.column(5).to_numpy(), part.column(4).to_numpy()))
                continue
            if held:
                x, second, ids = (np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            if not len(x):
                continue
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q, s, seconds in zip(_matrix(part.column(7), dim), part.column(4).to_pylist(), part.column(6).to_pylist(), strict=True):
                mask = np.zeros(wide, bool)
                mask[seconds] = True
                on = np.flatnonzero(mask[second])
                d = _distances(x[on], q)
                first = np.lexsort((ids[on], d))[:most]
                out.append((np.full(len(first), s), ids[on][first], d[first]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["search", "entry", "score"])


def search(
    vectors: DataFrame, *, k: int = 10, every: int = 100, recall: float = 0.96, entries_per_cell: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row whose vec_id is divisible by ``every``.

    ``vectors`` has ``vec_id, embedding``. Score: Euclidean distance in double precision; ties
    go to the smaller vec_id. A row's own id is no candidate. Rows without an id take no part,
    nor do vectors that are null, zero, hold null or non-finite components or have another
    length than most. Of rows that repeat an id one takes part, as ``usable`` says. ``recall`` is the share of true neighbours that the walk is
    measured for. No queries or no other vectors give an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, dim = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    smallest = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = materialise(smallest.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.element_at("ids", 1)), "entries")
    n = entries.count()
    index = build(entries, dim, n, k, recall, entries_per_cell)
    wide = len(index.second)

    asked = materialise(rows.where(F.col("vec_id") % every == 0), "queries")
    searches = asked.select("v").distinct().withColumn("search", F.monotonically_increasing_id())
    searches = materialise(searches, "searches")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            rows: list[tuple[int, int, list[int]]] = []
            for i, s in enumerate(b.column(0).to_pylist()):
                by_first: dict[int, list[int]] = {}
                for cell in index.walk(x[i]):
                    by_first.setdefault(cell // wide, []).append(cell % wide)
                rows += [(s, a, c) for a, c in by_first.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["search", "a", "seconds"])

    visits = materialise(searches.select("search", "v").repartition(shuffle_partitions(spark)).mapInArrow(walk, "search long, a int, seconds array<int>"), "visits")
    # blocks of either side by first centroid: at most MOST_CENTROIDS counts
    per_first = index.counts.reshape(len(index.first), wide).sum(axis=1)
    asked_of = {r["a"]: r["count"] for r in visits.groupBy("a").count().collect()}
    block = max(1, BLOCK_BYTES // (8 * dim))
    entry_blocks = [int(-(-c // block)) or 1 for c in per_first.tolist()]
    search_blocks = [int(-(-asked_of.get(a, 0) // BLOCK_SEARCHES)) or 1 for a in range(len(per_first))]
    pick = lambda blocks: F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("a") + 1)

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells // wide, pa.int32()), pa.array(cells % wide, pa.int32()), b.column(1)], ["entry", "a", "second", "v"])

    placed = entries.select("entry", "v").mapInArrow(first_of, "entry long, a int, second int, v array<double>")
    eb, sb = F.pmod(F.xxhash64("entry"), pick(entry_blocks)).cast("int"), F.sequence(F.lit(0), pick(search_blocks) - 1)
    none = F.lit(None).cast("array<int>").alias("seconds")
    left = placed.select("a", eb.alias("eb"), F.explode(sb).alias("sb"), F.lit(0).alias("side"), F.col("entry").alias("id"), "second", none, "v")
    both = visits.join(searches, "search")
    eb, sb = F.sequence(F.lit(0), pick(entry_blocks) - 1), F.pmod(F.xxhash64("search"), pick(search_blocks)).cast("int")
    right = both.select("a", F.explode(eb).alias("eb"), sb.alias("sb"), F.lit(1).alias("side"), F.col("search").alias("id"), F.lit(0).alias("second"), "seconds", "v")
    met = left.unionByName(right).repartition(shuffle_partitions(spark), "a", "eb", "sb").sortWithinPartitions("a", "eb", "sb", "side")
    near = met.mapInArrow(lambda it: _rerank(it, wide, dim, k + 1), "search long, entry long, score double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("search").orderBy("score", "entry"))).where(F.col("r") <= k + 1)
    hits = best.select("search", "entry", "score").join(entries.select("entry", "ids"), "entry").select("search", "score", F.explode("ids").alias("vec_id"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("search").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    hits = hits.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))
    hits = hits.join(searches, "search").select("v", "hits")
    if searches.count() <= BROADCAST_SEARCHES:
        hits = F.broadcast(hits)  # a vector that very many rows ask for gathers in no task
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(hits, "v")
    others = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
