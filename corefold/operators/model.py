"""The pair classifier: hard negatives, training, scoring, ensembles, leave-one-country-out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import md5_bucket
from .features import NAMES


def holdout(rows: DataFrame, id_col: str = "s1_id") -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows), by a hash of the record's id: the same split everywhere and every time."""
    bucket = md5_bucket(F.col(id_col))
    return rows.where(bucket < tables.HOLDOUT[0]), rows.where(bucket >= tables.HOLDOUT[0])


def hard_negatives(labelled: DataFrame, most: int = 10, among: int = 20, rank: str = "rn") -> DataFrame:
    """All positives, and each record's ``most`` best-ranked negatives among its first ``among`` candidates."""
    place = F.row_number().over(Window.partitionBy("country", "s1_id", "label").orderBy(rank, "target_id"))
    rows = labelled.withColumn("__place", place)
    return rows.where((F.col("label") == 1) | ((F.col(rank) <= among) & (F.col("__place") <= most))).drop("__place")


def label_all(labelled: DataFrame, cap: int = 40, rank: str = "rn") -> DataFrame:
    """Every candidate up to ``cap``, with its label; true pairs that retrieval doesn't have are not added."""
    return labelled.where(F.col(rank) <= cap)


def sampled_negatives(labelled: DataFrame, most: int = 6, among: int = 25, rank: str = "rn") -> DataFrame:
    """All positives, and of each record's negatives among its first ``among`` candidates ``most`` by a hash of the pair: the same ones every time."""
    h = F.md5(F.concat_ws("|", "s1_id", "target_id").cast("binary"))
    inside = (F.col("label") == 0) & (F.col(rank) <= among)
    place = F.row_number().over(Window.partitionBy("country", "s1_id", inside).orderBy(h, "target_id"))
    rows = labelled.withColumn("__in", inside).withColumn("__place", place)
    return rows.where((F.col("label") == 1) | (F.col("__in") & (F.col("__place") <= most))).drop("__in", "__place")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_weights(labelled: DataFrame, most: float = 20.0) -> DataFrame:
    """``weight``: positives weigh as many times more as there are more negatives, up to ``most``."""
    n = labelled.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos = n["pos"] or 0
    heavy = min((n["n"] - pos) / pos, most) if pos else 1.0
    return labelled.withColumn("weight", F.when(F.col("label") == 1, heavy).otherwise(1.0))


def train(labelled: DataFrame, kind: str = "m1", features: tuple[str, ...] = NAMES, seed: int = 7, **options: object) -> PipelineModel:
    """``m1``: boosted trees. ``m2``: a forest, to differ from it. ``labelled`` has the features, ``label`` and ``weight``."""
    if kind == "m1":
        learner = GBTClassifier(**{"labelCol": "label", "weightCol": "weight", "maxDepth": 5, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": seed} | options)
    else:
        learner = RandomForestClassifier(**{"labelCol": "label", "weightCol": "weight", "numTrees": 40, "maxDepth": 8, "seed": seed} | options)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learner]).fit(labelled)


def score(model: PipelineModel, pairs: DataFrame, out: str = "prob") -> DataFrame:
    scored = model.transform(pairs)
    return scored.select(*pairs.columns, vector_to_array("probability")[1].alias(out))


def ensemble(models: list[PipelineModel], pairs: DataFrame, out: str = "prob") -> DataFrame:
    """The mean of several models' probabilities."""
    rows = pairs
    for i, m in enumerate(models):
        rows = score(m, rows, f"__p{i}")
    mean = sum((F.col(f"__p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return rows.withColumn(out, mean).drop(*[f"__p{i}" for i in range(len(models))])


def leave_one_country_out(labelled: DataFrame, kind: str = "m1", **options: object) -> DataFrame:
    """Each country's pairs scored by a model of the others. A row a country is listed on the driver."""
    out = None
    for r in labelled.select("country").distinct().orderBy("country").collect():
        here = F.col("country") == r["country"]
        model = train(with_weights(labelled.where(~here)), kind, **options)
        part = score(model, labelled.where(here))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else labelled.withColumn("prob", F.lit(0.0))
