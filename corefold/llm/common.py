"""What the operators share: scratch tables, running totals, connected components.

Lineage is cut with tables written in the shared folder that ``spark.checkpoint.dir``
names. Such a table outlives the executor that wrote it, so a lost executor costs the
tasks that ran there and nothing that had been written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and bytes, in a batch that a Python worker gets: a batch of whole texts stays in the megabytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20

#: Narrow rows in a file of a scratch table.
ROWS_A_FILE = 250_000
#: Input of a task that reads a table, as it lies on disk.
BYTES_A_TASK = 8 << 20
#: Edges from which a hub can have so many that its join is worth splitting.
MANY_EDGES = 2_000_000
_own: set[str] = set()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``, so that no worker holds thousands of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` as a URI; a temporary one only in local mode, where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="corefold-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder. All of an application's places go when its JVM ends, or with ``discard``."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/corefold/{sc.applicationId}"
    if folder not in _own:
        _own.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(sc._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return folder


def discard(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Delete this application's scratch tables now, but for places in ``but``. Tables that still read them break."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if store.exists(path):
        kept = {x.rstrip("/").rpartition("/")[2] for x in but}
        for status in store.listStatus(path):
            if status.getPath().getName() not in kept:
                store.delete(status.getPath(), True)


def materialise(df: DataFrame, name: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, with its lineage cut.

    ``rows``: about how many narrow rows it has, if that is known. Then a task writes up to
    ``ROWS_A_FILE`` of them, and small tables don't become hundreds of files.
    """
    if rows is not None:
        df = df.coalesce(max(1, min(shuffle_partitions(df.sparkSession), -(-rows // ROWS_A_FILE))))
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, which reads a table without a shuffle, in no more tasks than have some work: four times the cores, or one for each ``BYTES_A_TASK``.

    Many small files are then read together, and what the tasks write isn't as many files. A
    size that isn't known counts as large.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // BYTES_A_TASK)), 1 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_sample(df: DataFrame, by: list[str], most: int, n: int) -> DataFrame:
    """At most ``most`` of the ``n`` rows: those with the smallest hashes of ``by``; the same ones every time.

    Hashes beyond twice the share that is wanted are dropped where they are read, so what is
    sorted in one place is bounded by ``most`` and not by the number of tasks.
    """
    h = F.xxhash64(*by)
    rows = df.withColumn("__h", h)
    if n > 4 * most:
        rows = rows.where(F.shiftrightunsigned(h, 1) < int((1 << 63) * 2 * most / n))
    return rows.orderBy("__h", *by).limit(most).drop("__h")


def running_total(df: DataFrame, values: dict[str, str], order: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """For each ``column: name`` of ``values`` add ``name``: the column's sum over the rows before, within ``keys``, in ``order``.

    No key goes to one task whole: rows are dealt by range of (keys, order) into slices, each
    slice is summed up, and a row's total is its slice's base plus the sum within the slice.
    Only one row for each slice and each key that it holds is gathered. Rows that tie in
    ``order`` come in any order among themselves. An empty table gives an empty table.
    """
    spark = df.sparkSession
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    parts = materialise(df.repartitionByRange(shuffle_partitions(spark), *by).withColumn("__slice", F.spark_partition_id()), "slices")
    sums = parts.groupBy("__slice", *keys).agg(*[F.sum(v).alias(f"__sum_{n}") for v, n in values.items()])
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("__slice").alias("__s"), *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in values.values()],
    )
    inner = Window.partitionBy("__slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"__local_{n}") for v, n in values.items()])
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    totals = [(F.col(f"__base_{n}") + F.col(f"__local_{n}")).alias(n) for n in values.values()]
    return local.join(bases, on).select(*[c for c in parts.columns if c != "__slice"], *totals)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``, root being its component's smallest node.

    Alternating large-star and small-star steps: each is a map-side combined minimum by node
    and a join, and a hub's edges are only ever joined to one row. In a large graph the minima
    are written before they are joined, so that the join's sides are plain shuffles and a
    hub's edges can be split. Rounds grow with the logarithm of the longest path.
    """
    cur = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    sig = _signature(cur)

    def minima(of: DataFrame) -> DataFrame:
        least = of.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        return materialise(least, "least") if sig[0] >= MANY_EDGES else least

    for _ in range(most_rounds if sig[0] else 0):
        n = 2 * sig[0]
        both = cur.union(cur.select("b", "a"))
        large = both.join(minima(both), F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large-star", n)
        joined = large.join(minima(large), F.col("a") == F.col("u"))
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        cur = materialise(small.distinct(), "small-star", n)
        was, sig = sig, _signature(cur)
        if was == sig:
            break
    else:
        if sig[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())
