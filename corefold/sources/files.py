"""Tab-separated records, truth and ID lists; Parquet tables for what is kept between steps."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType = RECORD, *, strict: bool = True, header: bool = True) -> DataFrame:
    """Rows of a tab-separated file: nothing is quoted, nothing means null, fields are trimmed.

    ``strict`` raises where the header lacks a column, and rows that are short have empty
    fields; else such rows are dropped.
    """
    if not strict:
        # a line is one field here: the first line of each file goes, and no other that is equal to it
        lines = spark.read.option("sep", "\u0001").option("quote", "").option("escape", "").option("header", header).option("enforceSchema", True)
        fields = F.split(F.regexp_replace(F.col("value"), "\r+$", ""), "\t")
        rows = lines.schema("value string").csv(path).select(fields.alias("f")).where(F.size("f") >= len(schema))
        return rows.select(*[F.trim(F.col("f")[i]).alias(c) for i, c in enumerate(schema.names)])
    reader = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("nullValue", "\u0000").option("emptyValue", "")
    if header:
        have = [c.strip() for c in (spark.read.text(path).first() or [""])[0].split("\t")]
        missing = [f.name for f in schema if f.name not in have]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
    rows = reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in schema.names])


def truth_edges(truth: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, target_id) of a list column: items trimmed, empty ones dropped, each pair once."""
    items = F.explode(F.split(F.coalesce(F.col(list_col), F.lit("")), ","))
    edges = truth.select(F.trim(F.col(id_col)).alias("s1_id"), items.alias("item")).select("s1_id", F.trim("item").alias("target_id"))
    return edges.where("target_id <> ''").distinct()


def id_lists(spine: DataFrame, pairs: DataFrame, out: str = "matched_entity_ids") -> DataFrame:
    """One row for every S1 id of ``spine`` with its distinct targets, sorted and joined; empty without any."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(out))
    return spine.select("s1_id").distinct().join(lists, "s1_id", "left").select("s1_id", F.coalesce(out, F.lit("")).alias(out))


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Tab-separated with a header and line feeds; with ``order``, one file in that column's order."""
    df = df.coalesce(1).sortWithinPartitions(order) if order else df
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line) of a text file, or of files in the order of their names: lines from 0, however many tasks read a file.

    A line's place is that in its block, after the lines of the blocks before; one count a block is joined back.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("__file", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(starts), ["__file", "__block"]).select("value", (F.col("__before") + F.col("__at") - F.col("__first")).alias("line"))


def write_by_country(df: DataFrame, path: str) -> None:
    """Parquet by country, so that a reader of one country reads no other."""
    df.write.mode("overwrite").partitionBy("country").parquet(path)


def claims(scored: DataFrame) -> DataFrame:
    """(s1_id, target_id, prob) with the probability to six places, as it is ranked later."""
    return scored.select("s1_id", "target_id", F.round("prob", 6).alias("prob"))


def first_per_country(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each country with the smallest ids."""
    rank = F.row_number().over(Window.partitionBy("country").orderBy("entity_id"))
    return rows.withColumn("position", rank).where(F.col("position") <= n)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``; one of its own only in local mode, where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="corefold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the JVM ends."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return path.toString()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its store, for readers on workers."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(found).toString()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: computed once, its lineage cut, and each reader reads the columns it needs."""
    path = scratch_path(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, which reads files, dealt out where it has fewer partitions than there are cores; a larger one is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shard_of(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """Add ``shard``: rows in order of ``order`` in ``shards`` equal runs, the last one perhaps shorter.

    Rows are dealt by range into as many parts as a shuffle has, strings like numbers. A row's
    place is its place in its part after the rows of the parts before; no task gets all rows,
    and one count a part is joined back.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a part
    whole = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("__all"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    per = F.ceil(F.col("__all") / shards)
    out = parts.join(F.broadcast(starts), "__part").withColumn("shard", F.floor(place / per).cast("int"))
    return out.select(*rows.columns, "shard")


def sample(rows: DataFrame, wanted: DataFrame, share: float, id_col: str = "entity_id", most: int | None = None) -> DataFrame:
    """All rows whose id is wanted, and of the others those whose md5 falls in ``share``: the same rows every time, in other engines too.

    With ``most``, no more than that of the others: those with the smallest hashes.
    """
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("binary")), 1, 8), 16, 10).cast("bigint")
    marked = rows.join(wanted.select(F.col(id_col).alias("__id")).distinct(), F.col(id_col) == F.col("__id"), "left")
    marked = marked.withColumn("__h", h)
    extra = marked.where(F.col("__id").isNull() & (F.col("__h") % 1_000_000 < int(share * 1_000_000)))
    if most is not None:
        extra = extra.orderBy("__h", id_col).limit(most)
    return marked.where(F.col("__id").isNotNull()).unionByName(extra).drop("__id", "__h")


def replace_countries(old: DataFrame, new: DataFrame, countries: list[str], expected: int | None = None) -> DataFrame:
    """Rows of ``new`` for some countries and of ``old`` for the others. ``expected``: how many rows there have to be."""
    named: Column = F.col("country").isin(countries)
    return checked(old.where(~named).unionByName(new.where(named)), expected)


def merge_parts(parts: list[DataFrame], spine: DataFrame, id_col: str = "s1_id") -> DataFrame:
    """Outputs of several countries or shards as one table, which has to have one row for each id of ``spine``."""
    out = reduce(DataFrame.unionByName, parts)
    ids, known = out.select(id_col), spine.select(id_col).distinct()
    again, lost, strange = ids.groupBy(id_col).count().where("count > 1"), known.join(ids, id_col, "left_anti"), ids.join(known, id_col, "left_anti")
    n = [x.count() for x in (again, lost, strange)]
    if any(n):
        raise ValueError(f"{n[0]} ids more than once, {n[1]} missing, {n[2]} unknown")
    return out


def checked(rows: DataFrame, expected: int | None) -> DataFrame:
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows and not {expected}")
    return rows
