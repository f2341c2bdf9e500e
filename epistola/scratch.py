"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only in local mode, where ``spark.checkpoint.dir`` is unset.
LOCAL_SCRATCH = "/tmp/epistola-scratch"


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_SCRATCH
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/epistola-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back; the driver deletes the table when it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_path(spark: SparkSession, name: str, sources: list[str]) -> str:
    """A folder of this application's for what is derived from the tables at ``sources`` as they are now: their files, sizes and times are part of its name."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = [name]
    for source in sources:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        state += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in at.getFileSystem(conf).listStatus(at))
    digest = hashlib.sha256("\n".join(state).encode()).hexdigest()[:24]
    return f"{scratch_root(spark)}/epistola-held-{name}-{spark.sparkContext.applicationId}-{digest}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def drop(df: DataFrame) -> None:
    """Delete the written table behind ``df`` once nothing reads it any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/epistola-" in p}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows that go to a Python worker at once, where the session has Spark's default of 10,000: bodies may be long.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


#: Rows up to which a table is sent to all workers.
FEW_ROWS = 100_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """For a join: ``df`` to be broadcast if it has at most ``most`` rows, which are counted that far; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, *order: Column | str, by: str | None = None, name: str = "n") -> DataFrame:
    """``df``, written, with numbers from 0 in ``order``, without gaps; with ``by``, the first column of the order, within each of its values. No task
    sees more than its part of the sorted rows."""
    at, part = "_at", "_part"
    rows = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)), "numbered")
    keys = [part, *([by] if by else [])]
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.min(at).alias("_low"))
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    parts = parts.withColumn("_before", F.coalesce(F.sum("_m").over(window), F.lit(0)))
    return rows.join(F.broadcast(parts) if not by else parts, keys).select(*(f"`{c}`" for c in df.columns), (F.col(at) - F.col("_low") + F.col("_before")).alias(name))
