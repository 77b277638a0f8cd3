"""Decisions over scored pairs (country, s1_id, target_id, prob): gates, rescue, one-to-one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import tables
from ..functions import text as T


def _per_record() -> object:
    return Window.partitionBy("country", "s1_id")


def gate(scored: DataFrame, th: Column | float, mt: Column | float) -> DataFrame:
    """Pairs of at least ``th``, of records whose best pair has at least ``mt``; the best is of all their candidates."""
    th, mt = (x if isinstance(x, Column) else F.lit(x) for x in (th, mt))
    best = F.max("prob").over(_per_record())
    return scored.withColumn("__best", best).where((F.col("__best") >= mt) & (F.col("prob") >= th)).drop("__best")


def filter_then_gate(scored: DataFrame, th: float, mt: float) -> DataFrame:
    """The first generation's order; the same pairs wherever ``mt`` is at least ``th``."""
    return gate(scored.where(F.col("prob") >= th), th, mt)


def veto_and_rescue(scored: DataFrame, th: float) -> DataFrame:
    """A conflict of pins is a veto unless the addresses agree; an address that agrees, with a pin or numbers, is enough.

    Needs ``a_sort``, ``pin_match``, ``pin_conflict`` and ``num_ov``.
    """
    near = F.col("a_sort") >= 0.90
    prob = F.when((F.col("pin_conflict") == 1) & ~near, 0.0).otherwise(F.col("prob"))
    rescued = near & ((F.col("pin_match") == 1) | (F.col("num_ov") >= 0.5))
    return scored.withColumn("prob", F.when(rescued, F.greatest(prob, F.lit(th))).otherwise(prob))


def gated_rescue(scored: DataFrame, th: float) -> DataFrame:
    """The third generation's rescue, which wants names that agree as well."""
    rescued = (F.col("a_sort") >= 0.90) & ((F.col("pin_match") == 1) | (F.col("num_ov") >= 0.5)) & (F.col("n_sort") >= 0.85)
    return scored.withColumn("prob", F.when(rescued, F.greatest("prob", F.lit(th))).otherwise(F.col("prob")))


def propagate(scored: DataFrame, accepted: DataFrame, prints: DataFrame, floor: float) -> DataFrame:
    """Accepted pairs, and pairs of at least ``floor`` whose target shares a fingerprint with one the record accepted."""
    fp = prints.where("fp <> ''").select("country", F.col("entity_id").alias("target_id"), "fp")
    groups = accepted.select("country", "s1_id", "target_id").join(fp, ["country", "target_id"]).select("country", "s1_id", "fp").distinct()
    more = scored.where(F.col("prob") >= floor).join(fp, ["country", "target_id"]).join(groups, ["country", "s1_id", "fp"])
    columns = ["country", "s1_id", "target_id", "prob"]
    return accepted.select(*columns).unionByName(more.select(*columns)).distinct()


def adaptive(scored: DataFrame, th: float, mt: float, shift: dict[str, float] | None = None) -> DataFrame:
    """The threshold moves with the country and with how many candidates a record has."""
    n = F.count(F.lit(1)).over(_per_record())
    by_country = F.lit(0.0)
    for country, d in (shift or {}).items():
        by_country = F.when(F.col("country") == country, d).otherwise(by_country)
    few = F.when(n <= 2, -0.05).when(n >= 20, 0.05).otherwise(0.0)
    rows = scored.withColumn("__th", F.greatest(F.lit(th) + by_country + few, F.lit(0.1)))
    return gate(rows, F.col("__th"), F.greatest(F.lit(mt), F.col("__th"))).drop("__th")


def phonetic_rescue(scored: DataFrame, low: float, th: float, similarity: float, mt: float | None) -> DataFrame:
    """Pairs over ``th``, and those from ``low`` whose collapsed names agree; with ``mt`` the record's best still has to reach it.

    Needs ``a_name_norm`` and ``b_name_norm``.
    """
    alike = S.token_set(T.phonetic_collapse(F.col("a_name_norm")), T.phonetic_collapse(F.col("b_name_norm"))) >= similarity
    found = scored.withColumn("__best", F.max("prob").over(_per_record()))
    kept = found.where((F.col("prob") >= th) | ((F.col("prob") >= low) & alike))
    return (kept if mt is None else kept.where(F.col("__best") >= mt)).drop("__best")


def rules_table(spark: SparkSession, rules: tuple = tables.RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "country string, tag string, model string, th double, mt double")


def with_rules(scored: DataFrame, rules: DataFrame, default: tuple = tables.DEFAULT_RULE) -> DataFrame:
    """``scored`` with its country's ``tag, model, th, mt``, or the default's. ``rules`` has a row a country, joined as its size lets it."""
    tag, model, th, mt = default
    out = scored.join(rules, "country", "left")
    return out.withColumns({"tag": F.coalesce("tag", F.lit(tag)), "model": F.coalesce("model", F.lit(model)), "th": F.coalesce("th", F.lit(th)), "mt": F.coalesce("mt", F.lit(mt))})


def one_to_one(claims: DataFrame, score: Column | None = None, ties: tuple[str, ...] = ("s1_id",)) -> DataFrame:
    """Each target's best claim. Scores are compared to six places; ties go to the smaller S1 id."""
    score = F.round("prob", 6) if score is None else score
    rows = claims.withColumn("__score", score)
    w = Window.partitionBy("country", "target_id").orderBy(F.desc("__score"), *[F.desc(t) if t == "prob" else F.col(t) for t in ties])
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place", "__score")


def street_score(a: Column, b: Column) -> Column:
    """By how much a claim counts for its streets: half if either has none, else from half to whole by overlap."""
    overlap = F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.5)).otherwise(S.jaccard(a, b))
    return F.col("prob") * (0.5 + 0.5 * overlap)


def one_to_one_street(claims: DataFrame) -> DataFrame:
    """Needs ``a_street`` and ``b_street``; ties go to the greater probability, then the smaller S1 id."""
    return one_to_one(claims, F.round(street_score(F.col("a_street"), F.col("b_street")), 6), ("prob", "s1_id"))


def drop_other_streets(claims: DataFrame, always: list[str]) -> DataFrame:
    """Drop claims without a street in common: in some countries always, in others where the target has another claim.

    A contested target that would lose all its claims keeps the best one.
    """
    a, b = F.col("a_street"), F.col("b_street")
    meets = (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
    w = Window.partitionBy("country", "target_id")
    rows = claims.withColumn("__meets", meets).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__any", F.max("__meets").over(w))
    first = F.row_number().over(w.orderBy(F.desc("prob"), "s1_id"))
    rows = rows.withColumn("__first", first)
    strict = F.col("country").isin(always)
    keep = F.when(strict | (F.col("__n") > 1), F.col("__meets") | (~strict & ~F.col("__any") & (F.col("__first") == 1))).otherwise(True)
    return rows.where(keep).drop("__meets", "__n", "__any", "__first")


def one_to_one_text(claims: DataFrame, with_address: bool = True) -> DataFrame:
    """By text alone: names, and addresses for two fifths. Needs ``a_`` and ``b_name_norm`` and ``_addr_norm``."""
    score = S.jaro_winkler(F.col("a_name_norm"), F.col("b_name_norm"))
    if with_address:
        score = 0.6 * score + 0.4 * S.token_sort("a_addr_norm", "b_addr_norm")
    return one_to_one(claims, F.round(score, 6))
