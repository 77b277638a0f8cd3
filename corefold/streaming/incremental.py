"""New records of the first source against a standing pool, micro-batch by micro-batch.

The pool's postings are written once, pruned and laid out by key; each batch makes its keys,
joins them and is decided as in the batch plan. One-to-one assignment holds within a batch;
``settle`` assigns across all that was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tables
from ..operators import decide, features, keys, records, retrieval


def write_pool(pool: DataFrame, path: str, most: int = tables.MOST_POSTINGS) -> None:
    """Normalised target records under ``path``, their numbers in the order of ids, and their pruned postings, a list a key."""
    spark = pool.sparkSession
    pool.write.mode("overwrite").parquet(f"{path}/records")
    retrieval.write_numbered(pool.select(F.col("entity_id").alias("target_id")).distinct(), f"{path}/targets")
    made = keys.make(pool).select("country", "ktype", "key", F.col("entity_id").alias("target_id"))
    retrieval.write_posting_lists(made, f"{path}/targets", f"{path}/postings", most)


def link_batch(batch: DataFrame, pool_path: str, variant: retrieval.Variant, th: float, mt: float) -> DataFrame:
    """Matches of one batch of normalised records."""
    spark = batch.sparkSession
    pool = spark.read.parquet(f"{pool_path}/records")
    asked = keys.make(batch).select("country", "ktype", "key", F.col("entity_id").alias("s1_id"))
    found = retrieval.ranked_lists(asked, f"{pool_path}/postings", f"{pool_path}/targets", variant.k0)
    scored = features.pseudo_probability(found, batch.unionByName(pool))
    return decide.one_to_one(decide.gate(scored, th, mt)).select("country", "s1_id", "target_id", "prob")


def start(stream: DataFrame, pool_path: str, out_path: str, checkpoint: str, variant: str = "x2", th: float = 0.62, mt: float = 0.62, read: Callable[[DataFrame], DataFrame] = records.normalise) -> StreamingQuery:
    """Link a stream of records; each batch's claims go to a folder of their own, so that a repeated batch replaces itself."""
    chosen = retrieval.VARIANTS[variant]

    def run(batch: DataFrame, epoch: int) -> None:
        link_batch(read(batch), pool_path, chosen, th, mt).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(claims: DataFrame) -> DataFrame:
    """One record for each target over all batches."""
    return decide.one_to_one(claims).select("country", "s1_id", "target_id", "prob")
