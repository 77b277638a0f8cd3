"""Features of candidate pairs: one projection, the kernels in one crossing to Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .retrieval import PAIR, with_texts
from .vectors import Space, pair_cosine

RECORD = ("name_norm", "addr_norm", "core_toks", "addr_toks", "numbers", "pins", "first_tok", "is_s2")
#: The canonical vector, in order; the first 33 are the third generation's.
NAMES = (
    "n_jw", "n_lev", "n_sort", "n_set", "n_partial", "n_cos", "core_jac", "core_cont", "n_len", "a_jw", "a_lev", "a_sort", "a_set", "a_partial", "a_cos",
    "a_jac", "a_len", "num_ov", "num_a", "num_b", "pin_match", "pin_both", "pin_conflict", "num_conflict", "x_sort", "x_min_set", "x_mean_set",
    "x_sort_num", "x_set_jw", "is_s2", "first_eq", "name_eq", "core_eq", "n_char4", "a_char4",
)

#: The vectors of the generations: names of features by position. The baseline has whether countries are equal and no conflicts.
VECTORS = {
    "v8": NAMES, "v4": NAMES[:33], "boost": NAMES[:33],
    "baseline": (*(n for n in NAMES[:33] if n not in ("pin_conflict", "num_conflict")), "country_eq"),
}


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _side(c: str) -> tuple[Column, Column]:
    return F.col(f"a_{c}"), F.col(f"b_{c}")


def exact_features() -> dict[str, Column]:
    """Those that need no kernel."""
    name, addr, core, toks, nums, found, first = (_side(c) for c in RECORD[:7])
    both = lambda x: (F.size(x[0]) > 0) & (F.size(x[1]) > 0)
    meet = lambda x: F.arrays_overlap(*x)
    distinct = lambda x: F.array_sort(F.array_distinct(x))
    return {
        "n_lev": S.guarded(*name, S.levenshtein(*name)),
        "core_jac": S.jaccard(*core),
        "core_cont": S.containment(*core),
        "n_len": F.when((name[0] == "") | (name[1] == ""), 0.0).otherwise(S.length_ratio(*name)),
        "a_lev": S.guarded(*addr, S.levenshtein(*addr)),
        "a_jac": S.jaccard(*toks),
        "a_len": F.when((addr[0] == "") | (addr[1] == ""), 0.0).otherwise(S.length_ratio(*addr)),
        "num_ov": S.jaccard(*nums),
        "num_a": F.size(nums[0]).cast("double"),
        "num_b": F.size(nums[1]).cast("double"),
        "pin_match": _flag(both(found) & meet(found)),
        "pin_both": _flag(both(found)),
        "pin_conflict": _flag(both(found) & ~meet(found)),
        "num_conflict": _flag(both(nums) & ~meet(nums)),
        "is_s2": _flag(F.col("b_is_s2")),
        "first_eq": _flag((first[0] != "") & (first[0] == first[1])),
        "name_eq": _flag((name[0] != "") & (name[0] == name[1])),
        "core_eq": _flag((F.size(core[0]) > 0) & (distinct(core[0]) == distinct(core[1]))),
        "n_char4": S.gram_jaccard(*name),
        "a_char4": S.gram_jaccard(*addr),
    }


def pair_features(pairs: DataFrame, records: DataFrame, cosines: DataFrame | None = None, spaces: dict[str, Space] | None = None) -> DataFrame:
    """``pairs`` with all of NAMES.

    ``cosines`` (s1_id, target_id, n_cos, a_cos) fills the slots of the TF-IDF cosines, 0
    where a pair is missing; ``spaces`` ("n", "a") says how to make them of the pairs' own
    texts; without either they hold the sorted-token ratio.
    """
    joined = with_texts(pairs, records, RECORD)
    if cosines is not None:
        found = cosines.select("s1_id", "target_id", F.col("n_cos").alias("__n_cos"), F.col("a_cos").alias("__a_cos"))
        joined = joined.join(found, ["s1_id", "target_id"], "left").na.fill(0.0, ["__n_cos", "__a_cos"])
    elif spaces is not None:
        joined = joined.withColumns({f"__{side}_cos": pair_cosine(spaces[side], f"a_{c}", f"b_{c}") for side, c in (("n", "name_norm"), ("a", "addr_norm"))})
    joined = joined.withColumn("n", S.kernels("a_name_norm", "b_name_norm")).withColumn("a", S.kernels("a_addr_norm", "b_addr_norm"))
    kernel = {f"{side}_{k}": F.col(f"{side}.{k}") for side in "na" for k in S.KERNELS}
    plain = exact_features() | kernel | {
        f"{side}_cos": F.col(f"{side}.sort") if cosines is None and spaces is None else F.col(f"__{side}_cos") for side in "na"
    }
    plain |= {
        "x_sort": F.col("n.sort") * F.col("a.sort"), "x_min_set": F.least("n.set", "a.set"), "x_mean_set": (F.col("n.set") + F.col("a.set")) / 2,
        "x_sort_num": F.col("n.sort") * plain["num_ov"], "x_set_jw": F.col("a.set") * F.col("n.jw"),
    }
    return joined.select(*pairs.columns, *[plain[c].cast("double").alias(c) for c in NAMES])


def exact_pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    made = exact_features()
    return with_texts(pairs, records, RECORD).select(*PAIR, *[F.round(v, 6).alias(k) for k, v in made.items()])


def pseudo_probability(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``prob`` from token overlap and the relative key score: a scorer that needs no training.

    0.35 name, 0.55 address, 0.10 keys, as the shipped variants weigh them.
    """
    made = exact_features()
    joined = with_texts(pairs, records, RECORD)
    best = F.max("idf").over(Window.partitionBy("country", "s1_id"))
    prob = 0.35 * made["core_jac"] + 0.55 * made["a_jac"] + 0.10 * F.col("idf") / best
    return joined.select(*pairs.columns, F.round(prob, 6).alias("prob"), *[F.round(made[c], 6).alias(c) for c in ("a_jac", "num_ov", "pin_match", "pin_conflict")])
