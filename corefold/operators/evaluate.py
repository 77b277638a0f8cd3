"""Evaluation against truth edges (s1_id, target_id), and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from .decide import propagate

EDGE = ["s1_id", "target_id"]


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """1 where nothing is there and nothing is found; 0 without a hit; else 1.25 pr / (0.25 p + r)."""
    p, r = tp / predicted, tp / true
    return F.when((predicted == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_f05(spine: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_true, f05) for every record of the spine; no prediction counts as the empty set."""
    p = predicted.select(*EDGE).distinct().withColumn("p", F.lit(1))
    t = truth.select(*EDGE).distinct().withColumn("t", F.lit(1))
    per = p.join(t, EDGE, "full").groupBy("s1_id").agg(
        F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true")
    )
    rows = spine.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return rows.withColumn("f05", F.round(f05(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6))


def macro_f05(per_entity: DataFrame) -> DataFrame:
    return per_entity.agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def recall_at(candidates: DataFrame, truth: DataFrame, caps: tuple[int, ...] = (10, 15, 20, 30, 40), rank: str = "rn") -> DataFrame:
    """(cap, hits, pairs, recall): the share of true pairs among the first ``cap`` candidates; one scan for all caps."""
    found = truth.select(*EDGE).distinct().join(candidates.select(*EDGE, rank), EDGE, "left")
    sums = found.agg(F.count(F.lit(1)).alias("pairs"), *[F.count(F.when(F.col(rank) <= c, 1)).alias(f"h{c}") for c in caps])
    rows = sums.select("pairs", F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"h{c}").alias("hits")) for c in caps])).alias("x"))
    return rows.select("x.cap", "x.hits", "pairs", F.round(F.try_divide(F.col("x.hits"), F.col("pairs")), 6).alias("recall"))


def grid_one_to_one(
    scored: DataFrame, spine: DataFrame, truth: DataFrame, ths: tuple[float, ...] = tables.GRID, mts: tuple[float, ...] = tables.GRID, by: tuple[str, ...] = (),
) -> DataFrame:
    """(th, mt, macro_f05) for every pair of thresholds, each after its own one-to-one assignment.

    With ``by`` = ("country",) for every country by itself; ``spine`` has the column then.
    Assignments aren't made one by one: of a target's claims in order, one wins for all ``mt``
    up to its record's best probability and above those of the claims before it. So a claim
    is accepted in one rectangle of the grid, found by a running maximum.
    """
    ahead = Window.partitionBy("country", "target_id").orderBy(F.desc("prob"), "s1_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_best(scored).withColumn("low", F.coalesce(F.max("best").over(ahead), F.lit(-1.0))).where("low < best")
    return _macro_by(rows, spine, truth, ths, mts, by=by)


def sweep(scored: DataFrame, spine: DataFrame, truth: DataFrame, ths: tuple[float, ...], mts: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The same without the assignment."""
    return _macro_by(_with_best(scored).withColumn("low", F.lit(-1.0)), spine, truth, ths, mts, by=by)


def cap_sweep(scored: DataFrame, spine: DataFrame, truth: DataFrame, caps: tuple[int, ...] = (12, 16, 20), ths: tuple[float, ...] = tables.GRID, mts: tuple[float, ...] = tables.GRID) -> DataFrame:
    """(cap, th, mt, macro_f05) over the first ``cap`` candidates by probability, for ``mt`` from ``th`` on; all caps in one pass."""
    rows = _with_best(scored).withColumn("low", F.lit(-1.0))
    return _macro_by(rows, spine, truth, ths, mts, caps=caps).where("mt >= th").select("cap", "th", "mt", "macro_f05")


def rescue_sweep(
    scored: DataFrame, spine: DataFrame, truth: DataFrame, rescued: Column, caps: tuple[int, ...] = (12, 16, 20), ths: tuple[float, ...] = tables.GRID, mts: tuple[float, ...] = tables.GRID,
) -> DataFrame:
    """(cap, rescue, th, mt, macro_f05): the same with and without raising the pairs that ``rescued`` says to the threshold.

    Such a pair is over every ``th``, and its record's best is then at least ``th``, which
    opens the gate where ``mt`` is ``th``.
    """
    rows = _with_best(scored.withColumn("raised", rescued)).withColumn("low", F.lit(-1.0))
    rows = rows.withColumn("any_raised", F.max("raised").over(Window.partitionBy("country", "s1_id")))
    return _macro_by(rows, spine, truth, ths, mts, caps=caps, rescue=True).where("mt >= th").select("cap", "rescue", "th", "mt", "macro_f05")


def _with_best(scored: DataFrame) -> DataFrame:
    """Probabilities to six places, as ranking compares them, with the record's best and the place among its candidates."""
    rows = scored.withColumn("prob", F.round("prob", 6))
    w = Window.partitionBy("country", "s1_id")
    return rows.withColumn("best", F.max("prob").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("prob"), "target_id")))


def _macro_by(
    claims: DataFrame, spine: DataFrame, truth: DataFrame, ths: tuple[float, ...], mts: tuple[float, ...], by: tuple[str, ...] = (), caps: tuple[int, ...] | None = None, rescue: bool = False,
) -> DataFrame:
    """Macro F0.5 for each cell of the grid. A record without a prediction adds 1 if nothing is true of it, else 0.

    Those are counted once and not listed for each cell. Claims are dealt by record once; a
    record's cells are made, counted and scored there, and only sums by cell are shuffled.
    """
    cells = [*(["cap"] if caps else []), *(["rescue"] if rescue else []), "th", "mt"]
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs])
    t = truth.select(*EDGE).distinct().withColumn("t", F.lit(1))
    counts = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    n_true = spine.select("s1_id", *by).distinct().join(counts, "s1_id", "left").na.fill(0, ["n_true"])
    whole = n_true.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("n_true") == 0, 1)).alias("alone"))
    rows = claims.where(F.col("place") <= max(caps)) if caps else claims
    rows = rows.join(t, EDGE, "left").repartition("s1_id")
    if caps:
        rows = rows.withColumn("cap", F.explode(numbers(caps))).where("place <= cap")
    raised = F.lit(False)
    if rescue:
        rows = rows.withColumn("rescue", F.explode(numbers((False, True))))
        raised = F.col("rescue") & F.col("raised")
    rows = rows.withColumn("th", F.explode(F.filter(numbers(ths), lambda x: (x <= F.col("prob")) | raised)))
    opened = F.col("rescue") & F.col("any_raised") & (F.col("th") >= F.col("best")) if rescue else F.lit(False)
    rows = rows.withColumn("mt", F.explode(F.filter(numbers(mts), lambda x: (x > F.col("low")) & ((x <= F.col("best")) | (opened & (x <= F.col("th")))))))
    per = rows.groupBy("s1_id", *cells).agg(F.count("t").alias("tp"), F.count(F.lit(1)).alias("n_pred")).join(n_true, "s1_id")
    score = f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    sums = per.groupBy(*cells, *by).agg(F.sum(score).alias("s"), F.count(F.when(F.col("n_true") == 0, 1)).alias("wrong"))
    lists = {"cap": caps or (), "rescue": (False, True), "th": ths, "mt": mts}
    grid = whole
    for c in cells:
        grid = grid.withColumn(c, F.explode(numbers(lists[c])))
    out = grid.join(sums, [*cells, *by], "left").na.fill(0, ["s", "wrong"])
    return out.select(*by, *cells, F.round((F.col("s") + F.col("alone") - F.col("wrong")) / F.col("entities"), 6).alias("macro_f05"))


def best_rule(per_country: DataFrame) -> DataFrame:
    """The best thresholds of each country; ties go to the smaller thresholds."""
    w = Window.partitionBy("country").orderBy(F.desc("macro_f05"), "th", "mt")
    return per_country.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def weighted(per_country: DataFrame, shares: DataFrame) -> DataFrame:
    """One figure of several countries', weighted by their shares of the test records."""
    rows = per_country.join(shares, "country")
    return rows.agg(F.round(F.sum(F.col("macro_f05") * F.col("share")) / F.sum("share"), 6).alias("combined"))


def taxonomy(spine: DataFrame, candidates: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(missed, rejected, merged, exact): pairs never retrieved, retrieved and turned down, accepted in error; records all right."""
    marks = [(d.select(*EDGE).distinct().withColumn(c, F.lit(1))) for d, c in ((truth, "t"), (candidates, "c"), (predicted, "p"))]
    rows = marks[0].join(marks[1], EDGE, "full").join(marks[2], EDGE, "full")
    t, c, p = (F.col(x).isNotNull() for x in "tcp")
    per = rows.groupBy("s1_id").agg(
        F.count(F.when(t & ~c, 1)).alias("missed"), F.count(F.when(t & c & ~p, 1)).alias("rejected"), F.count(F.when(p & ~t, 1)).alias("merged"),
        F.count(F.when(t & ~p, 1)).alias("lost"),
    )
    whole = spine.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0)
    return whole.agg(
        F.sum("missed").alias("missed"), F.sum("rejected").alias("rejected"), F.sum("merged").alias("merged"),
        F.count(F.when((F.col("lost") == 0) & (F.col("merged") == 0), 1)).alias("exact"),
    )


def misses(truth: DataFrame, candidates: DataFrame, shared: DataFrame) -> DataFrame:
    """(hit, no_key, ranked_out): true pairs retrieved, without a key in common, and with one but not retrieved."""
    c = candidates.select(*EDGE).distinct().withColumn("c", F.lit(1))
    k = shared.select(*EDGE).distinct().withColumn("k", F.lit(1))
    rows = truth.select(*EDGE).distinct().join(c, EDGE, "left").join(k, EDGE, "left")
    hit, key = F.col("c").isNotNull(), F.col("k").isNotNull()
    return rows.agg(F.count(F.when(hit, 1)).alias("hit"), F.count(F.when(~hit & ~key, 1)).alias("no_key"), F.count(F.when(~hit & key, 1)).alias("ranked_out"))


def candidate_precision(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    labelled = label(candidates, truth)
    return labelled.agg(F.round(F.avg("label"), 6).alias("candidate_precision"), F.sum("label").cast("long").alias("positives"), F.count(F.lit(1)).alias("candidates"))


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select(*EDGE).distinct().withColumn("__t", F.lit(1))
    return candidates.join(t, EDGE, "left").withColumn("label", F.col("__t").isNotNull().cast("int")).drop("__t")


def missing_truth(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs that retrieval doesn't have: what training adds, and evaluation must not."""
    return truth.select(*EDGE).distinct().join(candidates.select(*EDGE), EDGE, "left_anti")


def extension(scored: DataFrame, accepted: DataFrame, prints: DataFrame, spine: DataFrame, truth: DataFrame, floors: tuple[float, ...] = (0.3, 0.4, 0.5)) -> DataFrame:
    """(floor, added, added_good, macro_f05) of accepting siblings from each floor; what the least floor adds holds all others."""
    t = truth.select(*EDGE).distinct().withColumn("t", F.lit(1))
    first = accepted.select(*EDGE).distinct().withColumn("accepted", F.lit(1))
    wide = propagate(scored, accepted, prints, min(floors)).join(first, EDGE, "left").join(t, EDGE, "left")
    rows = wide.repartition("s1_id").withColumn("floor", F.explode(F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: F.col("accepted").isNotNull() | (F.col("prob") >= f))))
    new = F.col("accepted").isNull()
    per = rows.groupBy("s1_id", "floor").agg(
        F.count(F.when(new, 1)).alias("added"), F.count(F.when(new, F.col("t"))).alias("added_good"), F.countDistinct("target_id").alias("n_pred"),
        F.countDistinct(F.when(F.col("t").isNotNull(), F.col("target_id"))).alias("tp"),
    )
    n_true = spine.select("s1_id").distinct().join(t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true")), "s1_id", "left").na.fill(0, ["n_true"])
    whole = n_true.agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("n_true") == 0, 1)).alias("alone"))
    score = F.round(f05(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6)
    sums = per.join(n_true, "s1_id").groupBy("floor").agg(
        F.sum("added").alias("added"), F.sum("added_good").alias("added_good"), F.sum(score).alias("s"), F.count(F.when(F.col("n_true") == 0, 1)).alias("wrong")
    )
    out = whole.withColumn("floor", F.explode(F.array(*[F.lit(f) for f in floors]))).join(sums, "floor", "left").na.fill(0, ["added", "added_good", "s", "wrong"])
    return out.select("floor", "added", "added_good", F.round((F.col("s") + F.col("alone") - F.col("wrong")) / F.col("entities"), 6).alias("macro_f05"))


def cluster_rule(scored: DataFrame, prints: DataFrame, truth: DataFrame, floors: tuple[float, ...] = (0.5, 0.6, 0.7)) -> DataFrame:
    """(floor, accepted, good): each record's best pair in every fingerprint, from each floor on."""
    fp = prints.select("country", F.col("entity_id").alias("target_id"), "fp")
    best = scored.join(fp, ["country", "target_id"]).groupBy("country", "s1_id", "fp").agg(F.max("prob").alias("prob"), F.max_by("target_id", F.struct("prob", "target_id")).alias("target_id"))
    rows = label(best, truth)
    sums = rows.agg(*[F.struct(F.lit(f).alias("floor"), F.count(F.when(F.col("prob") >= f, 1)).alias("accepted"), F.count(F.when((F.col("prob") >= f) & (F.col("label") == 1), 1)).alias("good")).alias(f"f{i}") for i, f in enumerate(floors)])
    return sums.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(floors))])).alias("x")).select("x.*")


def profile(records: DataFrame) -> DataFrame:
    """A row for each source: rows, distinct ids, empty names and addresses in percent, mean tokens of a name, countries."""
    source = F.substring("entity_id", 1, 2).alias("source")
    words = F.size(F.filter(F.split(F.trim("business_name"), r"\s+"), lambda t: t != ""))
    return records.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("ids"),
        F.round(100 * F.avg(F.when(F.trim("business_name") == "", 1).otherwise(0)), 4).alias("empty_names"),
        F.round(100 * F.avg(F.when(F.trim("business_address") == "", 1).otherwise(0)), 4).alias("empty_addresses"),
        F.round(F.avg(words), 4).alias("name_tokens"), F.countDistinct("country").alias("countries"),
    )


def top_countries(records: DataFrame, n: int = 10) -> DataFrame:
    """(source, country, n, repeated_ids, empty_names, empty_addresses, place): each source's largest countries; ties by name."""
    source = F.substring("entity_id", 1, 2).alias("source")
    empty = lambda c: F.round(100 * F.avg(F.when(F.trim(c) == "", 1).otherwise(0)), 4)
    rows = records.groupBy(source, "country").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("entity_id")).alias("repeated_ids"),
        empty("business_name").alias("empty_names"), empty("business_address").alias("empty_addresses"),
    )
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "country"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def truth_histogram(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """(matches, entities, s2, s3): how many records have how many matches, and of which source these are."""
    t = truth.select(*EDGE).distinct()
    per = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(F.startswith("target_id", F.lit("S2-")), 1)).alias("s2"), F.count(F.when(F.startswith("target_id", F.lit("S3-")), 1)).alias("s3"))
    rows = spine.select("s1_id").distinct().join(per, "s1_id", "left").na.fill(0)
    return rows.groupBy("matches").agg(F.count(F.lit(1)).alias("entities"), F.sum("s2").alias("s2"), F.sum("s3").alias("s3"))
