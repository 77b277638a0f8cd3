"""Candidate retrieval: postings, pruning, key joins, scores, top-k, rescoring, siblings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import tables
from ..sources import files
from . import keys as K

PAIR = ["country", "s1_id", "target_id"]


@dataclass(frozen=True)
class Variant:
    """How candidates are ranked: by key score to ``k0``, then by weighted name, address and key score to ``cap``."""

    k0: int
    name: float
    address: float
    idf: float
    neutral: float | None
    cap: int


VARIANTS = {tag: Variant(*v) for tag, v in tables.VARIANTS.items()}


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("country", "ktype", "key").agg(F.count(F.lit(1)).alias("df"))


def cap_of(ktype: Column, most: int, caps: dict[str, int] | None = None) -> Column:
    caps = tables.KEY_CAPS if caps is None else caps
    out = F.lit(most)
    for name, cap in caps.items():
        out = F.when(ktype == name, min(cap, most)).otherwise(out)
    return out


def overflow_cap(n: int, bucket: int = 750, share: float = 0.0003, most: int = 2000) -> int:
    """Second generation: a bucket's limit grows with the pool up to ``most``."""
    return max(bucket, min(most, int(share * n)))


def prune(postings: DataFrame, most: int = tables.MOST_POSTINGS, caps: dict[str, int] | None = None) -> DataFrame:
    """``postings`` with ``df``, without keys that have more than their cap.

    Counting combines map-side. Keys beyond their cap are few, each having so many postings,
    and go by an anti-join: adaptive execution broadcasts their list where it is small, and
    then no stop key's postings ever meet in one task. What is joined to its frequency after
    that has at most ``most`` rows a key.
    """
    keys = ["country", "ktype", "key"]
    df, cap = document_frequency(postings), cap_of(F.col("ktype"), most, caps)
    kept = postings.join(df.where(F.col("df") > cap).select(*keys), keys, "left_anti")
    return kept.join(df.where(F.col("df") <= cap), keys)


def split_sides(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    queries = keyed.where("is_s1").select("country", "ktype", "key", F.col("entity_id").alias("s1_id"))
    targets = keyed.where(~F.col("is_s1")).select("country", "ktype", "key", F.col("entity_id").alias("target_id"))
    return queries, targets


def shared_keys(keyed: DataFrame, most: int = tables.MOST_POSTINGS, caps: dict[str, int] | None = None) -> DataFrame:
    """(country, s1_id, target_id, ktype, key, df): every key that a record of S1 and a target share.

    The frequency is that among targets; a key's pairs are bounded by its cap, whatever the
    queries are, and a frequent key among queries is split by the skew join.
    """
    queries, targets = split_sides(keyed)
    weighted = prune(targets, most, caps).withColumn("weight", key_weight())  # once a posting and not once a pair
    return queries.join(weighted, ["country", "ktype", "key"])


def key_weight() -> Column:
    """What a shared key adds to a pair's score: by its type and rarity."""
    return K.weight(F.col("ktype")) / F.log1p(F.col("df"))


#: Postings up to which an index is broadcast to its queries, some 60 bytes each.
SMALL_INDEX = 500_000


def probe(queries: DataFrame, index: DataFrame, small: int = SMALL_INDEX) -> DataFrame:
    """Queries' keys joined to a pruned index: broadcast where it is counted and small, shuffled beyond."""
    index = index.withColumnRenamed("entity_id", "target_id").select("country", "ktype", "key", "target_id", "df")
    if index.limit(small + 1).count() <= small:
        index = F.broadcast(index)
    return queries.join(index, ["country", "ktype", "key"])


def idf_scores(shared: DataFrame) -> DataFrame:
    """(country, s1_id, target_id, idf, hits): weighted by type and rarity, and merely counted."""
    weight = F.col("weight") if "weight" in shared.columns else key_weight()
    # keys of a pair lie apart, so little would combine before the shuffle; dealt by record, what ranks a record's pairs finds them together
    return shared.select(*PAIR, weight.alias("weight")).repartition("country", "s1_id").groupBy(*PAIR).agg(F.round(F.sum("weight"), 6).alias("idf"), F.count(F.lit(1)).alias("hits"))


def top(scored: DataFrame, k: int, score: str = "idf", rank: str = "rn") -> DataFrame:
    """The ``k`` best of each S1 record; ties go to the smaller target."""
    w = Window.partitionBy("country", "s1_id").orderBy(F.desc(score), "target_id")
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(keyed: DataFrame, k: int, score: str = "idf", rank: str = "rn", most: int = tables.MOST_POSTINGS, caps: dict[str, int] | None = None) -> DataFrame:
    """``top(idf_scores(shared_keys(keyed, most, caps)), k, score, rank)`` without a row for each shared key.

    Targets get numbers in the order of their ids. A key's targets are one list, bounded by its
    cap, in the shared folder. What is shuffled are numbers of keys; a task reads the lists of a
    block of records, ranks them, and only a record's ``k`` best leave as rows.
    """
    queries, targets = split_sides(keyed)
    names = numbered(targets.select("target_id").distinct())
    return ranked_lists(queries, posting_lists(targets, names, most, caps), names, k, score, rank)


def numbered(targets: DataFrame) -> str:
    """Where ``targets``, one row for each ``target_id``, lie in its order with numbers ``__n``."""
    path = files.scratch_path(targets.sparkSession, "targets") + "/table"
    write_numbered(targets, path)
    return path


def write_numbered(targets: DataFrame, path: str) -> None:
    in_order = targets.repartitionByRange("target_id").sortWithinPartitions("target_id")
    in_order.withColumn("__n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


def posting_lists(targets: DataFrame, names: str, most: int = tables.MOST_POSTINGS, caps: dict[str, int] | None = None) -> str:
    path = files.scratch_path(targets.sparkSession, "lists") + "/table"
    write_posting_lists(targets, names, path, most, caps)
    return path


def write_posting_lists(targets: DataFrame, names: str, path: str, most: int = tables.MOST_POSTINGS, caps: dict[str, int] | None = None) -> None:
    """(country, ktype, key, __k, targets, weight): the pruned postings of a key as a list of the targets' numbers, with a number of its own."""
    pruned = prune(targets, most, caps).join(targets.sparkSession.read.parquet(names).select("target_id", "__n"), "target_id")
    lists = pruned.groupBy("country", "ktype", "key").agg(F.sort_array(F.collect_list("__n")).alias("targets"), F.first("df").alias("df"))
    lists = lists.select("country", "ktype", "key", F.monotonically_increasing_id().alias("__k"), "targets", key_weight().alias("weight"))
    lists.write.mode("overwrite").parquet(path)


def ranked_lists(
    queries: DataFrame, lists: str, names: str, k: int, score: str = "idf", rank: str = "rn", texts: DataFrame | None = None, variant: Variant | None = None,
) -> DataFrame:
    """The ``k`` best targets of each record of ``queries`` (country, ktype, key, s1_id) by the lists of its keys.

    With ``texts`` (country, s1_id, name_norm, addr_norm), and these columns in ``names`` too, the ``k`` are rescored
    as ``variant`` says where they are ranked, and its cap leaves.
    """
    spark = queries.sparkSession
    lists, names = (files.qualified(spark, x) for x in (lists, names))
    met = queries.join(spark.read.parquet(lists).select("country", "ktype", "key", "__k"), ["country", "ktype", "key"])
    asked = met.groupBy("country", "s1_id").agg(F.sort_array(F.collect_list("__k")).alias("keys"))
    columns = f"{rank} int"
    if variant is not None:
        asked, columns = asked.join(texts, ["country", "s1_id"]), "combined double, rn int"
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.repartition(tasks, "s1_id")  # by other columns than they were grouped by: else that shuffle would do, and be read by few tasks
    return dealt.mapInArrow(_best_of(lists, names, k, score, variant, rank), f"country string, s1_id string, target_id string, idf double, hits long, {columns}")


#: Records whose lists a task holds at a time.
RECORDS = 512


def _taken(path: str, by: str, wanted: np.ndarray, columns: list[str]) -> pa.Table:
    """The rows of the table at ``path`` with the numbers ``wanted``, which are in order, in their order."""
    store, inside = fs.FileSystem.from_uri(path)
    found = []
    dataset = pads.dataset(inside, format="parquet", filesystem=store)
    for batch in dataset.to_batches(columns=[by, *columns], batch_readahead=1, fragment_readahead=1):
        n = batch.column(0).to_numpy()
        at = np.minimum(np.searchsorted(wanted, n), len(wanted) - 1)
        if (hit := wanted[at] == n).any():
            found.append(batch.filter(pa.array(hit)))
    return pa.Table.from_batches(found, schema=found[0].schema if found else pa.schema([dataset.schema.field(c) for c in (by, *columns)])).sort_by(by).combine_chunks()


def _offsets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends in the flattened array, and that array."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten().to_numpy()


def _rounded(x: np.ndarray, unit: float = 1e6) -> np.ndarray:
    return np.floor(x * unit + 0.5) / unit


def _first(k: int, score: np.ndarray) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first; ties as they come."""
    some = np.arange(len(score))
    if len(score) > 2 * k:
        some = np.nonzero(score >= np.partition(score, len(score) - k)[len(score) - k])[0]
    return some[np.argsort(-score[some], kind="stable")][:k]


def _best_of(lists: str, names: str, k: int, score: str, variant: Variant | None, rank: str):  # noqa: ANN202
    out = ["country", "s1_id", "target_id", "idf", "hits", *(["combined", "rn"] if variant else [rank])]

    def block(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds, numbers = _offsets(asked["keys"].combine_chunks())
        if not len(numbers):
            return
        wanted = np.unique(numbers)
        index = _taken(lists, "__k", wanted, ["targets", "weight"])
        starts, flat = _offsets(index["targets"].combine_chunks())
        targets, local = np.unique(flat, return_inverse=True)
        weights, lengths, place = index["weight"].to_numpy(), np.diff(starts), np.searchsorted(index["__k"].to_numpy(), numbers)
        found = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            mine = place[low:high]
            met = np.concatenate([local[starts[i] : starts[i + 1]] for i in mine])
            each = np.repeat(weights[mine], lengths[mine])
            if 8 * len(met) < len(targets):
                at, met = np.unique(met, return_inverse=True)
                hits, idf = np.bincount(met), np.bincount(met, each)
            else:
                hits, idf = np.bincount(met), np.bincount(met, each)
                at = np.nonzero(hits)[0]
                hits, idf = hits[at], idf[at]
            idf = _rounded(idf)
            best = _first(k, idf if score == "idf" else hits)
            found.append((at[best], idf[best], hits[best]))
        used = np.unique(np.concatenate([x[0] for x in found]))
        known = _taken(names, "__n", targets[used], ["target_id", *(["name_norm", "addr_norm"] if variant else [])])
        found = [(np.searchsorted(used, at), idf, hits) for at, idf, hits in found]
        more = []
        if variant is not None:
            name_b, addr_b = (known[c].to_pylist() for c in ("name_norm", "addr_norm"))
            sets, empty = (S.TokenSets(name_b), S.TokenSets(addr_b)), np.array([x == "" for x in addr_b], dtype=bool)
            for i, (name_a, addr_a) in enumerate(zip(asked["name_norm"].to_pylist(), asked["addr_norm"].to_pylist(), strict=True)):
                at, idf, hits = found[i]
                name, address = (_rounded(x.of(a, at), 100) for x, a in zip(sets, (name_a, addr_a), strict=True))
                if variant.neutral is not None:
                    address = np.where(empty[at] | (addr_a == ""), variant.neutral, address)
                combined = _rounded(variant.name * name + variant.address * address + variant.idf * idf / idf.max(initial=0))
                order = np.lexsort((at, -combined))[: variant.cap]
                found[i] = at[order], idf[order], hits[order]
                more.append(combined[order])
        n = [len(x[0]) for x in found]
        whose = pa.array(np.repeat(np.arange(len(found)), n))
        at, idf, hits = (np.concatenate([x[i] for x in found]) for i in range(3))
        scores = [pa.array(np.concatenate(more))] if variant else []
        places = pa.array(np.concatenate([np.arange(1, i + 1) for i in n]), pa.int32())
        rows = [asked[c].combine_chunks().take(whose) for c in ("country", "s1_id")] + [known["target_id"].combine_chunks().take(pa.array(at)), pa.array(idf), pa.array(hits, pa.int64()), *scores, places]
        yield from pa.Table.from_arrays(rows, names=out).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, RECORDS):
                part = batch.slice(low, RECORDS)
                if held and n + part.num_rows > RECORDS:
                    yield from block(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from block(pa.Table.from_batches(held))

    return run


def with_texts(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pairs`` with ``a_`` and ``b_`` columns of both records: texts join late, when few pairs are left.

    Pairs that have been ranked lie by country and record, and are not shuffled to meet the first side.
    """
    by = ["country", "s1_id"] if "country" in pairs.columns and "country" in records.columns and "country" not in columns else ["s1_id"]
    a = records.select(*by[:-1], F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = records.select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, by).join(b, "target_id")


def percent(value: Column) -> Column:
    """Ranking sees similarities in whole percents."""
    return F.round(value * 100) / 100


def address_score(similarity: Column, a: Column, b: Column, neutral: float | None) -> Column:
    """The neutral score where either address is empty: nothing speaks for or against."""
    return similarity if neutral is None else F.when((a == "") | (b == ""), F.lit(neutral)).otherwise(similarity)


def rescore(pairs: DataFrame, variant: Variant, name: Column, address: Column) -> DataFrame:
    """Add ``combined`` and ``rn``, best first, and keep the variant's cap. Key scores are relative to the record's best."""
    best = F.max("idf").over(Window.partitionBy("country", "s1_id"))
    combined = variant.name * name + variant.address * address_score(address, F.col("a_addr_norm"), F.col("b_addr_norm"), variant.neutral) + variant.idf * F.col("idf") / best
    return top(pairs.withColumn("combined", F.round(combined, 6)), variant.cap, "combined")


def retrieve(records: DataFrame, keyed: DataFrame, variant: Variant, most: int = tables.MOST_POSTINGS) -> DataFrame:
    """Two stages: by key score, then by text. All ``k0`` of a record are rescored where they are ranked, and its cap leaves."""
    queries, targets = split_sides(keyed)
    texts = records.select("country", "entity_id", "name_norm", "addr_norm")
    names = numbered(texts.join(targets.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(F.col("entity_id").alias("target_id"), "name_norm", "addr_norm"))
    mine = texts.withColumnRenamed("entity_id", "s1_id")
    return ranked_lists(queries, posting_lists(targets, names, most), names, variant.k0, texts=mine, variant=variant).select(*PAIR, "idf", "hits", "combined", "rn")


def phonetic_boost(combined: Column, similarity: Column, weight: float) -> Column:
    """The optional term for names that agree once collapsed."""
    return combined + weight * similarity


def union_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR).union(b.select(*PAIR)).distinct()


def with_siblings(candidates: DataFrame, prints: DataFrame, most: int = 16) -> DataFrame:
    """Candidates and, for each, the first ``most`` targets of its fingerprint, once each. ``prints``: entity_id, country, fp."""
    groups = prints.where("fp <> ''").withColumn("place", F.row_number().over(Window.partitionBy("country", "fp").orderBy("entity_id")))
    members = groups.where(F.col("place") <= most).select("country", "fp", F.col("entity_id").alias("sibling"))
    own = prints.where("fp <> ''").select("country", F.col("entity_id").alias("target_id"), "fp")
    more = candidates.select(*PAIR).join(own, ["country", "target_id"]).select("country", "s1_id", "fp").distinct().join(members, ["country", "fp"])
    return union_candidates(candidates, more.select("country", "s1_id", F.col("sibling").alias("target_id")))


def tfidf(docs: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), least_df: int = 2, most_features: int | None = None, sublinear: bool = False) -> DataFrame:
    """(doc, gram, w): unit vectors of word-bound character grams, each word padded by a space on both sides."""
    words = docs.select("doc", F.explode(F.filter(F.split("text", " "), lambda t: t != "")).alias("word")).withColumn("word", F.concat(F.lit(" "), "word", F.lit(" ")))
    made = F.concat(*[F.when(F.length("word") >= n, _grams(n)).otherwise(F.array().cast("array<string>")) for n in sizes])
    tf = words.select("doc", F.explode(made).alias("gram")).groupBy("doc", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_df)
    if most_features is not None:
        df = df.orderBy(F.desc("total"), "gram").limit(most_features)
    n = docs.select("doc").distinct().count()
    tf = tf.join(df, "gram")
    count = (1 + F.log("tf")) if sublinear else F.col("tf")
    raw = tf.select("doc", "gram", (count * (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "gram", (F.col("raw") / F.col("norm")).alias("w"))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substr(F.col("word"), i, F.lit(n)))


def cosine(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("gram",)) -> DataFrame:
    """(a, b, cos) of documents that share a gram, and what else they are joined on."""
    left = a.select(*[F.col(c) for c in on], F.col("doc").alias("a"), F.col("w").alias("wa"))
    right = b.select(*[F.col(c) for c in on], F.col("doc").alias("b"), F.col("w").alias("wb"))
    return left.join(right, list(on)).groupBy(*[c for c in on if c != "gram"], "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cos"))


def union_probe(queries: DataFrame, postings: list[DataFrame], k: int) -> DataFrame:
    """Several indexes probed as one: each ranks its own candidates and keeps ``max(k // n + 20, 60)``; a pair found by several counts with the first.

    ``queries``: (country, ktype, key, s1_id); ``postings``: the targets' keys with their ``df``.
    """
    share, found = max(k // max(len(postings), 1) + 20, 60), None
    for i, index in enumerate(postings):
        part = top(idf_scores(queries.join(index, ["country", "ktype", "key"])), share, rank="__rank").withColumn("index", F.lit(i))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy(*PAIR).agg(F.min_by(F.struct("idf", "hits"), "index").alias("x"), F.min("index").alias("index"))
    return top(first.select(*PAIR, "x.idf", "x.hits", "index"), k)


def compact(candidates: DataFrame, matches: DataFrame, most: int) -> DataFrame:
    """Matches first, then candidates by rank up to ``most``; matches always stay."""
    marked = candidates.join(matches.select("s1_id", "target_id").distinct().withColumn("is_match", F.lit(True)), ["s1_id", "target_id"], "left")
    marked = marked.withColumn("is_match", F.coalesce("is_match", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("is_match"), "rn", "target_id"))
    return marked.withColumn("place", place).where((F.col("place") <= most) | F.col("is_match"))
