"""A corpus pipeline over ``documents``: each stage calls one operator of ``corefold.llm`` and its decisions take effect.

Every stage gets what its predecessor kept, written as Parquet and read again, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corefold.llm import mixing, near_dup, packing, pii, quality
from corefold.llm.common import scratch_path
from corefold.llm.queries import quality_vocabularies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, the length being that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those without words or text too. Rows that repeat go or stay alike; an empty table stays one."""
    return quality.keep_good(docs.select(*COLUMNS), quality_vocabularies())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id: five words, similarity of 0.8 or more.

    Documents without words are no copies of each other and stay, a row without an id stays
    only where none of its group has one, and of rows that repeat id and text one stays, the
    smallest by the other columns. An empty table stays one.
    """
    return near_dup.drop(docs.select(*COLUMNS), shingle=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; every document stays, null and empty texts and repeated rows as they are."""
    return _sized(pii.redact(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last one of a source's budget is cut there.

    Texts without words aren't taken, a null source is one of its own, rows that repeat share
    what is left of a budget, and an empty table stays one.
    """
    return _sized(mixing.mixed_texts(docs.select(*COLUMNS), weights=(5, 2, 1), most_epochs=3))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the sequence and the offset where each lies; a null or empty text is a piece of the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifiers, the sampling and the tokenizers have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
