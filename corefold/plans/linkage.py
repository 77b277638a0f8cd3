"""Linkage from records to matches in one plan for all countries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import tables
from ..functions.text import md5_bucket
from ..operators import decide, evaluate, features, keys, model, records, retrieval, vectors
from ..sources import files


def candidates(normalised: DataFrame, variant: str = "x2", most: int = tables.MOST_POSTINGS, families: dict | None = None) -> DataFrame:
    return retrieval.retrieve(normalised, keys.make(normalised, families), retrieval.VARIANTS[variant], most)


def link(normalised: DataFrame, found: DataFrame, rules: DataFrame, trained_model: PipelineModel | None = None) -> DataFrame:
    """(country, s1_id, target_id, prob): of given candidates, scored by one model or by overlap, those that the rules' thresholds accept."""
    if trained_model is None:
        scored = features.pseudo_probability(found, normalised)
    else:
        scored = model.score(trained_model, features.pair_features(found, normalised))
    return decide_by(scored, rules)


def decide_by(scored: DataFrame, rules: DataFrame) -> DataFrame:
    """Each country's thresholds, and each target with one record."""
    decided = decide.with_rules(scored.select("country", "s1_id", "target_id", "prob"), rules)
    accepted = decide.gate(decided, F.col("th"), F.col("mt"))
    return decide.one_to_one(accepted).select("country", "s1_id", "target_id", F.round("prob", 6).alias("prob"))


def link_by_rules(normalised: DataFrame, rules: DataFrame, models: dict[str, PipelineModel] | None = None) -> DataFrame:
    """(country, s1_id, target_id, prob): accepted pairs, each target with one record.

    A country's rule says which variant finds its candidates, which model scores them and
    which thresholds decide; a country without one has the default's. Without models pairs
    are scored by overlap. Countries of one variant, and of one model, go together.
    """
    countries = normalised.select("country").distinct()
    ruled = decide.with_rules(countries, rules)
    tagged = normalised.join(ruled.select("country", "tag"), "country")
    used = ruled.select("tag", "model").distinct().collect()  # at most variants times models
    found = reduce(DataFrame.unionByName, [candidates(tagged.where(F.col("tag") == t).drop("tag"), t) for t in sorted({r["tag"] for r in used})])
    if models is None:
        scored = features.pseudo_probability(found, normalised)
    else:
        pairs = features.pair_features(found.select(*retrieval.PAIR), normalised).join(ruled.select("country", "model"), "country")
        names = sorted({r["model"] for r in used})
        scored = reduce(DataFrame.unionByName, [model.score(models[m], pairs.where(F.col("model") == m).drop("model")) for m in names])
    return decide_by(scored, rules)


#: What a rule chooses from, beside thresholds.
TAGS, KINDS = ("x1", "x2"), ("m1", "m2")


def trained(normalised: DataFrame, truth: DataFrame) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Models of the records outside the holdout, and each country's best rule there: variant, model and thresholds."""
    models, rules, _ = fitted(normalised, truth)
    return models, rules


def fitted(normalised: DataFrame, truth: DataFrame) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """``trained``, and all records' pairs, with the rank and each model's probability.

    A record's candidates depend on no other record of the first source, and the variants differ in
    their caps alone. So candidates and features are made once, of the widest variant and of all records, and every model's
    probabilities are written; learning, calibration and linking take their parts of them. Only records outside the
    holdout are learnt from and calibrated on, on the whole grid; ties go to the variant, model and thresholds that come first.
    """
    found = files.written(candidates(normalised, _widest()).select(*retrieval.PAIR, "rn"), "candidates")
    outside, true = _outside(F.col("s1_id")), truth.where(_outside(F.col("s1_id")))
    fit = model.with_weights(files.cut(train_pairs(normalised, found.where(outside & _of(F.lit(TAGS[-1]))), true)))
    models = {k: model.train(fit, k) for k in KINDS}
    scored = features.pair_features(found, normalised)
    for k in KINDS:
        scored = model.score(models[k], scored, f"prob_{k}")
    scored = files.written(scored.select(*found.columns, *[f"prob_{k}" for k in KINDS]), "scored")
    spine = normalised.where(F.col("is_s1") & _outside(F.col("entity_id"))).select(F.col("entity_id").alias("s1_id"), "country")
    tried = []
    for t in TAGS:
        for k in KINDS:
            pairs = scored.where(outside & _of(F.lit(t))).select(*retrieval.PAIR, F.col(f"prob_{k}").alias("prob"))
            grid = evaluate.grid_one_to_one(pairs, spine, true, by=("country",))
            tried.append(evaluate.best_rule(grid).select("country", F.lit(t).alias("tag"), F.lit(k).alias("model"), "th", "mt", "macro_f05"))
    best = reduce(DataFrame.unionByName, tried)
    w = Window.partitionBy("country").orderBy(F.desc("macro_f05"), "tag", "model", "th", "mt")
    rules = best.withColumn("place", F.row_number().over(w)).where("place = 1").select("country", "tag", "model", "th", "mt")
    return models, files.cut(rules), scored


def _widest() -> str:
    """The variant of TAGS whose candidates hold those of the others; they have to rank alike."""
    if len({replace(retrieval.VARIANTS[t], cap=0) for t in TAGS}) > 1:
        raise ValueError("variants of TAGS differ in more than their caps")
    return max(TAGS, key=lambda t: retrieval.VARIANTS[t].cap)


def _of(tag: F.Column) -> F.Column:
    """Whether a pair of the widest variant is one of this variant's, too."""
    cap = F.create_map(*[F.lit(x) for t in TAGS for x in (t, retrieval.VARIANTS[t].cap)])
    return F.col("rn") <= F.element_at(cap, tag)


def link_scored(scored: DataFrame, rules: DataFrame) -> DataFrame:
    """``link_by_rules`` of pairs that all models have scored (``fitted``)."""
    ruled = decide.with_rules(scored, F.broadcast(rules)).where(_of(F.col("tag")))  # a row a country
    prob = F.coalesce(*[F.when(F.col("model") == k, F.col(f"prob_{k}")) for k in KINDS])
    return decide_by(ruled.select(*retrieval.PAIR, prob.alias("prob")), rules)


def _outside(entity_id: F.Column) -> F.Column:
    return md5_bucket(entity_id) < tables.HOLDOUT[0]


def holdout_figures(normalised: DataFrame, truth: DataFrame) -> DataFrame:
    """(entities, macro_f05, pairs, recall_at_40) of the records in the holdout, by models and rules of the others."""
    _, rules, scored = fitted(normalised, truth)
    inside, true = scored.where(~_outside(F.col("s1_id"))), truth.where(~_outside(F.col("s1_id")))
    spine = normalised.where(F.col("is_s1") & ~_outside(F.col("entity_id"))).select(F.col("entity_id").alias("s1_id"))
    matched = link_scored(inside, rules)
    recall = evaluate.recall_at(inside.where(_of(F.lit("x2"))), true, (40,)).select("pairs", F.col("recall").alias("recall_at_40"))
    both = evaluate.macro_f05(evaluate.entity_f05(spine, matched, true)).unionByName(recall, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("entities", "macro_f05", "pairs", "recall_at_40")])


def train_pairs(normalised: DataFrame, found: DataFrame, truth: DataFrame, add_missing: bool = False) -> DataFrame:
    """Labelled hard pairs with all features. ``add_missing``: also true pairs that retrieval doesn't have."""
    labelled = model.hard_negatives(evaluate.label(found, truth))
    pairs = labelled.select("country", "s1_id", "target_id", "label")
    if add_missing:
        country = normalised.select(F.col("entity_id").alias("s1_id"), "country")
        lost = evaluate.missing_truth(found, truth).join(country, "s1_id")
        pairs = pairs.unionByName(lost.select("country", "s1_id", "target_id", F.lit(1).alias("label")))
    return features.pair_features(pairs, normalised)


def labelled_pairs(normalised: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """All candidates, labelled, with all features; unlike ``train_pairs`` no negative is left out."""
    return features.pair_features(evaluate.label(found.select(*retrieval.PAIR), truth), normalised)


def normalised_pages(pages: DataFrame, unicode: bool = False) -> DataFrame:
    return records.normalise(records.page_records(pages), unicode)


def baseline_candidates(normalised: DataFrame, bucket: int = 150, nearest: int = 50) -> DataFrame:
    """First generation: pairs that share a key of a small bucket, and each record's nearest by character grams."""
    made = keys.make(normalised, keys.families_g1())
    by_key = retrieval.shared_keys(made, bucket, {})
    docs = normalised.select(F.col("entity_id").alias("doc"), F.concat_ws(" ", "name_norm", "addr_norm").alias("text"), "country", "is_s1")
    near = vectors.nearest(vectors.fit(docs), docs, nearest).select("country", F.col("a").alias("s1_id"), F.col("b").alias("target_id"))
    return retrieval.union_candidates(by_key, near)


def link_baseline(normalised: DataFrame, th: float = 0.55, mt: float = 0.70) -> DataFrame:
    """First generation: keys and vectors, overlap, threshold and gate; no assignment."""
    found = baseline_candidates(normalised).withColumn("idf", F.lit(1.0))
    scored = features.pseudo_probability(found, normalised)
    return decide.filter_then_gate(scored.select("country", "s1_id", "target_id", "prob"), th, mt)


def link_boost(normalised: DataFrame, pool_size: int, most: int = 25, th: float = 0.5, mt: float = 0.5) -> DataFrame:
    """Second generation: six families, large buckets deleted, ranked by hits; veto, rescue, one-to-one by text."""
    made = keys.make(normalised, keys.families_g2())
    found = retrieval.ranked(made, most, "hits", most=retrieval.overflow_cap(pool_size), caps={})
    scored = retrieval.with_texts(features.pseudo_probability(found, normalised), normalised, ("addr_norm",))
    scored = scored.withColumn("a_sort", S.token_sort("a_addr_norm", "b_addr_norm"))
    accepted = decide.gate(decide.veto_and_rescue(scored, th).select("country", "s1_id", "target_id", "prob"), th, mt)
    texts = retrieval.with_texts(accepted, normalised, ("name_norm", "addr_norm"))
    return decide.one_to_one_text(texts).select("country", "s1_id", "target_id", "prob")
