"""Near-duplicates by SetSketch registers: linked where the shingle sets' Jaccard similarity is high enough.

A document's sketch has ``registers`` values, each the least of one hash of all its shingles,
taken as an exponential variable and rounded down on a logarithmic scale of base ``BASE``.
Sketches merge by the greater register, and two sets agree in a register with a chance close
to their similarity. The way from documents to components:

1. Documents with equal sets, exact copies above all, become one node.
2. A node's registers, banded, name its buckets. In a bucket each node is tied to the
   smallest one, so a bucket of n nodes gives n - 1 ties and never all pairs. Connected ties
   are clusters: any two nodes that share a bucket are in one.
3. Two nodes of a cluster that agree in a band are compared by the likelihood of their
   registers at all similarities; unless that rules the link out, and unless they are linked
   already through others, their whole sets decide.
4. A cluster that fits a block is compared at once. A larger one first meets its pivots, the
   nodes that most ties lead to, which costs no more than reading it: a large group of near
   copies is linked by that. What isn't in the cluster's largest component then is compared
   with all of the cluster, in pairs of blocks; two blocks of that component never are. To a
   pair of blocks only registers go, and then the texts of those nodes whose likelihood with
   some other node there leaves a link open.
5. The links that decide, at most one less than the nodes of a group, are connected.

No cap applies anywhere, and no link is lost to the pivots: they only spare comparisons
between nodes that they have linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected, materialise, shuffle_partitions, spread
from .words import Words, mix, set_key

#: Registers' scale. Close to 1, unequal minima seldom round to one value.
BASE = 1.001
REGISTERS = 252
#: The most that a linked pair may be missed: bands are as wide as that allows.
MOST_MISSED = 5e-6
#: Nodes, and shingles, that a block holds at most by rule; blocks are dealt by hash and vary a little.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
#: Nodes that all others of a large cluster are compared with first.
PIVOTS = 4
#: Nodes of clusters whose ids are broadcast to find their texts; 24 bytes each. Beyond, a shuffle join.
BROADCAST_NODES = 250_000
#: Bits of the bitmap that spares the shuffle of texts that no cluster has.
BITMAP_BITS = 28
HASHES_AT_ONCE = 1 << 15
#: Where the scale begins: a minimum of 64 times the mean of one shingle's variable.
FIRST = np.log(64) / np.log(BASE)
_A = np.random.default_rng(20240229).integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers, a row for each text of a batch; repeated shingles change nothing. Texts without any are 0."""
    out = np.zeros((len(at) - 1, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(at) > 0)
    if not len(some):
        return out
    starts, x = at[:-1][some], (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(some), REGISTERS), np.uint32)
    lo = 0
    while lo < len(some):  # some texts at a time: what is worked on stays in the cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + HASHES_AT_ONCE)))
        part, cuts = x[starts[lo] : at[some[hi - 1] + 1]], starts[lo:hi] - starts[lo]
        y = np.empty_like(part)
        for i in range(REGISTERS):
            np.multiply(part, _A[i], out=y)
            least[lo:hi, i] = np.minimum.reduceat(y, cuts)
        lo = hi
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    value = np.floor(1 + FIRST - np.log(exponential) / np.log(BASE))
    out[some] = np.clip(value, 1, 65535).astype(np.uint16)
    return out


def band_rows(least: float) -> int:
    """Registers a band, as many as leave a pair of this similarity together in some band but for ``MOST_MISSED``."""
    fits = [r for r in (4, 6, 7, 9, 12, 14, 18, 21) if (1 - least**r) ** (REGISTERS // r) <= MOST_MISSED]
    return max(fits, default=2)


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of ``rows`` registers, the band's number in it."""
    bands = REGISTERS // rows
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(regs), 1))
    parts = regs.reshape(len(regs), bands, rows).astype(np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, for registers that are greater, less and equal, and the first set's share ``u`` of both sizes."""
    c = 1 - 1 / BASE
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE), 1e-12)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))


def ruled_out(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, least: float, margin: float = 12.0) -> np.ndarray:
    """Where some similarity below ``least`` is more likely than ``least`` by a factor of e**margin.

    For sets that are linked, that happens once in over 100,000 pairs.
    """
    bound = np.minimum(u / (1 - u), (1 - u) / u)
    at = log_likelihood(more, less, same, u, np.minimum(least, bound))
    best = at.copy()
    for j in np.arange(0.02, least, 0.04):
        best = np.maximum(best, log_likelihood(more, less, same, u, np.minimum(j, bound)))
    return best - at > margin


class _Sets:
    """Union-find over the nodes of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def open_pairs(sizes: np.ndarray, regs: np.ndarray, sides: np.ndarray, roots: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows (i, j, equal registers) of nodes that share a band and that their registers don't rule out.

    Nodes of side 0 and 1 are compared with each other across sides; where all have side 2,
    with all others. ``num/den`` is the least similarity. Nodes of one root are linked already.
    """
    n = len(sizes)
    bands = np.ascontiguousarray(band_hashes(regs, band_rows(num / den)))
    across = bool((sides != 2).any())
    found: list[np.ndarray] = []
    for i in range(n):
        other = np.flatnonzero(sides[i + 1 :] != sides[i]) + i + 1 if across else np.arange(i + 1, n)
        other = other[roots[other] != roots[i]]
        if len(other):
            small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
            other = other[small * den >= large * num]
        if len(other):
            other = other[(bands[other] == bands[i]).any(axis=1)]
        if not len(other):
            continue
        r, mine = regs[other].astype(np.int32), regs[i].astype(np.int32)
        more, less = (mine > r).sum(axis=1), (mine < r).sum(axis=1)
        same = REGISTERS - more - less
        u = sizes[i] / (sizes[i] + sizes[other])
        # a register is the rounded negative logarithm of a minimum: the larger set has the greater ones
        keep = ~ruled_out(more, less, same, u, num / den)
        if keep.any():
            found.append(np.stack([np.full(int(keep.sum()), i), other[keep], same[keep]], axis=1).astype(np.int32))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int32)


def links_of(ids: list[int], sets: list[np.ndarray], regs: np.ndarray, sides: np.ndarray, num: int, den: int, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among these nodes; their whole sets decide. As for ``open_pairs``."""
    known = np.arange(len(ids)) if roots is None else np.unique(np.asarray(roots), return_inverse=True)[1]
    pairs = open_pairs(np.asarray([len(s) for s in sets], np.float64), regs, sides, known, num, den)
    pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]
    group, out = _Sets(len(ids)), []
    first: dict[int, int] = {}
    for k, root in enumerate(known.tolist()):
        group.join(k, first.setdefault(root, k))
    for lo in range(0, len(pairs), 1 << 16):
        for a, b, _ in pairs[lo : lo + (1 << 16)].tolist():
            if group.find(a) == group.find(b):
                continue
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both):
                group.join(a, b)
                out.append((ids[a], ids[b]))
    return out


def sketch(docs: DataFrame, size: int, rows: int) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, n_shingles, set_key`` and the node's buckets, ``bands``.

    A document without words has the key null and no buckets.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = Words(b.column(1)).shingles(size, True)
            bands = band_hashes(registers(hashes, at), rows).astype(np.int64)
            unique = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
            counts = [len(s) for s in unique]
            keys = [set_key(s) if len(s) else None for s in unique]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * (REGISTERS // rows), pa.int32()), pa.array(bands.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    hashed = docs.select(*cols, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return hashed.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of adjacent rows that agree in ``keys``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(nodes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _maybe(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without rows whose hash surely isn't wanted: a bitmap of ``2**BITMAP_BITS`` bits is built on the executors and broadcast, 32 MB at most."""
    at = lambda h: F.pmod(h, F.lit(1 << BITMAP_BITS))
    place = at(F.col("hash"))
    maps = wanted.select(F.shiftright(place, 15).alias("__bucket"), place.bitwiseAND(F.lit(32767)).alias("__bit"))
    maps = maps.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    place = at(F.col("text_hash"))
    rows = texts.withColumn("__bucket", F.shiftright(place, 15)).withColumn("__bit", place.bitwiseAND(F.lit(32767)).cast("int"))
    rows = rows.join(F.broadcast(materialise(maps, "bitmap")), "__bucket")
    byte = F.conv(F.hex(F.substr("__map", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, F.col("__bit").bitwiseAND(F.lit(7))) == 1).select(*texts.columns)


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``, which has ``doc`` and ``hash``, with the text of each row: broadcast up to a number of rows.

    Beyond it both sides are shuffled, of the texts only those that a bitmap of the wanted
    hashes leaves: not the whole corpus for what is a part of it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    rest = [c for c in wanted.columns if c not in ("doc", "hash")]
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    else:
        texts = _maybe(texts, wanted)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash")))
    return found.select(*rest, "text")


def _with_registers(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, size, regs`` of ``node, doc, hash``: texts are read where they are, and registers take their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = Words(b.column(1)).shingles(shingle, True)
            sizes = [len(np.unique(hashes[at[k] : at[k + 1]])) for k in range(len(at) - 1)]
            regs = [r.tobytes() for r in registers(hashes, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())], ["node", "size", "regs"])

    return _with_texts(docs, nodes).select("node", "text").mapInArrow(run, "node long, size long, regs binary")


def _undecided(paired: DataFrame, regs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``paired`` whose node may be linked to another one of its pair of blocks, by their registers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["cluster", "i", "j"]):
            t = t.take(pa.array(np.unique(t["node"].to_numpy(), return_index=True)[1]))  # a repeated row gives its node twice
            r = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            roots = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
            pairs = open_pairs(t["size"].to_numpy().astype(np.float64), r, t["side"].to_numpy(), roots, num, den)
            on = np.unique(pairs[:, :2])
            if len(on):
                yield from t.take(pa.array(on)).select(["node", "cluster", "i", "j"]).to_batches()

    n = shuffle_partitions(paired.sparkSession)
    rows = paired.select("node", "cluster", "i", "j", "side", "root").join(regs, "node")
    rows = rows.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    left = materialise(rows.mapInArrow(run, "node long, cluster long, i int, j int"), "undecided")
    return paired.join(left, ["node", "cluster", "i", "j"], "left_semi")


def _comparer(shingle: int, num: int, den: int) -> Callable[[DataFrame], DataFrame]:
    """From rows of ``_with_texts`` to the links that decide, group by group of (cluster, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["cluster", "i", "j"]):
            order = np.unique(t["node"].to_numpy(), return_index=True)[1]  # a repeated row gives its node twice
            if len(order) < 2:
                continue
            t = t.take(pa.array(order))
            hashes, at = Words(t["text"].combine_chunks()).shingles(shingle, True)
            sets = [np.unique(hashes[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
            out = links_of(t["node"].to_pylist(), sets, registers(hashes, at), t["side"].to_numpy(), num, den, t["root"].to_pylist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def compare(found: DataFrame) -> DataFrame:
        n = shuffle_partitions(found.sparkSession)
        return found.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")

    return compare


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, and ``text_hash``, for every row of ``doc_id, text``.

    Linked are documents with ``den * intersection >= num * union``. ``component_id`` is the
    smallest doc_id that links reach. A document without words has an empty set and is linked
    with nothing: its own id, kept. A null id counts as none: its component's smallest other
    id, or null where there is none, and it is kept only then. Rows that repeat an id with
    another text are documents of their own. An empty table gives an empty table.
    """
    rows = materialise(spread(sketch(docs, shingle, band_rows(num / den))), "sketches")
    solid = rows.where(F.col("set_key").isNotNull())
    same = solid.groupBy("set_key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
    )
    nodes = materialise(same.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # ties to the smallest node of each bucket
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("bucket", "hub")
    hubs = materialise(hubs, "hubs")  # the join's sides are plain shuffles then, and a hot bucket can be split
    ties = materialise(buckets.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "ties")
    n_ties = ties.count()
    clusters = materialise(connected(ties).withColumnRenamed("root", "cluster"), "clusters", 2 * n_ties)

    # members with where their text is, and their clusters' sizes in blocks
    members = clusters.join(nodes.select("node", "one", "n_shingles"), "node")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("cluster", _blocks(F.col("n"), F.col("s")).alias("blocks"), "n", "s")
    members = members.join(sizes.select("cluster", "blocks"), "cluster").select(
        "node", "cluster", "blocks", "n_shingles", F.col("one.doc_id").alias("doc"), F.col("one.text_hash").alias("hash")
    )
    members = materialise(members, "members", 2 * n_ties)
    compare = _comparer(shingle, num, den)
    links = None
    if members.where("blocks > 1").limit(1).count():
        # large clusters meet their pivots, chunk by chunk
        large = members.where("blocks > 1")
        popular = ties.join(large.select(F.col("node").alias("b"), "cluster"), "b").groupBy("cluster", "b").agg(F.count(F.lit(1)).alias("c"))
        place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "b"))
        pivots = popular.withColumn("place", place).where(F.col("place") <= PIVOTS).select(F.col("b").alias("node"), F.lit(True).alias("pivot"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = large.join(pivots, "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
        everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
        dealt = dealt.select("*", F.explode(F.when(F.col("pivot"), everywhere).otherwise(F.array(own))).alias("i"))
        dealt = dealt.select("node", "doc", "hash", "cluster", "i", F.lit(0).alias("j"), F.col("pivot").cast("int").alias("side"), F.col("node").alias("root"))
        links = materialise(compare(_with_texts(docs, materialise(dealt, "chunks"))), "pivot-links")
        known = connected(links).select("node", F.col("root").alias("known"))
        members = members.join(known, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known")
        counts = members.where("blocks > 1").groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("c"))
        main = materialise(counts.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("main")), "main", n_ties)
        members = members.join(main, "cluster", "left").withColumn("in_main", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    else:
        members = members.withColumn("root", F.col("node")).withColumn("in_main", F.lit(False))
    members = materialise(members, "rooted", 2 * n_ties)
    # blocks of the main component come first, and only pairs with a later block are compared
    parts = members.groupBy("cluster").agg(*[
        F.when(F.max(w.cast("int")) == 1, _blocks(F.sum(w.cast("int")), F.sum(F.when(w, F.col("n_shingles")).otherwise(0)))).otherwise(0).alias(c)
        for w, c in ((F.col("in_main"), "mains"), (~F.col("in_main"), "others"))
    ])
    members = members.join(materialise(parts, "parts", n_ties), "cluster").where("others > 0")
    block = F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")))
    partners = F.sequence(F.when(F.col("in_main"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    paired = members.withColumn("block", block.cast("int")).withColumn("partner", F.explode(partners))
    i, j = F.least("block", "partner"), F.greatest("block", "partner")
    side = F.when(i == j, 2).otherwise((F.col("block") == j).cast("int"))
    single = F.col("mains") + F.col("others") == 1
    paired = paired.select("node", "doc", "hash", "cluster", i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"), "root", single.alias("single"))
    paired = materialise(paired, "pairs")
    several = paired.where("not single").drop("single")
    paired = paired.where("single").drop("single")
    if several.limit(1).count():
        nodes_of = materialise(members.where(~single).select("node", "doc", "hash").distinct(), "several")
        regs = materialise(_with_registers(docs, nodes_of, shingle), "registers")
        paired = materialise(paired.unionByName(_undecided(several, regs, num, den)), "open-pairs")
    more = compare(_with_texts(docs, paired))
    roots = connected(more if links is None else more.unionByName(links))

    least = nodes.join(roots, "node", "left").select("node", "set_key", "least_id", F.coalesce("root", "node").alias("root"))
    component = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = least.join(component, "root").select("set_key", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    joined = solid.select("doc_id", "n_shingles", "text_hash", "set_key").join(named, "set_key").select("doc_id", "n_shingles", "component_id", kept, "text_hash")
    none = F.lit(0).cast("long").alias("n_shingles")
    empty = rows.where(F.col("set_key").isNull()).select("doc_id", none, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    return joined.unionByName(empty)


def drop(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but one of each group of near duplicates: that with the smallest doc_id stays.

    A row goes by its id and text. Rows that repeat both are copies too, and of them that with
    the smallest other columns stays, nulls first. Documents without words all stay. An empty
    table gives an empty table.
    """
    found = materialise(near_duplicates(docs, shingle=shingle, num=num, den=den).select("doc_id", "text_hash", "kept", "n_shingles"), "decisions")
    row = [F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")]
    here = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("__hash"))
    gone = found.where(~F.col("kept")).select(*row).distinct()
    again = materialise(found.where("kept and n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select(*row), "repeats")
    n_gone, n_again = gone.count(), again.count()
    bounded = lambda df, n: F.broadcast(df) if n <= BROADCAST_NODES else df
    left = docs.join(bounded(gone, n_gone), here, "left_anti")
    if not n_again:
        return left
    repeats = left.join(bounded(again, n_again), here, "left_semi")
    repeats = repeats.groupBy("doc_id", F.xxhash64("text").alias("__hash")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select(F.col("__row.*"))
    return left.join(bounded(again, n_again), here, "left_anti").unionByName(repeats)
