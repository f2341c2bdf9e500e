"""Shared plumbing of the training-data operators: tables, scratch tables, guards."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset, as in local tests.
LOCAL_SCRATCH = "/tmp/epistola-scratch"


#: Rows that go to a Python worker at once, where the session has Spark's default of 10,000: texts may be long.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_kept: dict[object, object] = {}


def keep[T](key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept by this worker process for the tasks after this one: one thing at a time, until a task calls ``release``."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give back what earlier tasks of this worker process left. Tasks that keep nothing begin with this: a worker serves
    all stages of a session, and would hold what another stage kept beside its own data."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed below what is in use
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a machine-local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/epistola-{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The driver deletes an existing path when it ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: lineage ends there. The table stays until the driver ends. options: the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table(s) behind ``df`` once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles() if "/epistola-" in p}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of one key from which ``join_spread`` treats it as hot, and the most keys that can be.
HOT_ROWS, MOST_HOT = 100_000, 10_000


def join_spread(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of a written table with one that has a row for each key. Keys that hold many rows of ``left`` are joined by
    broadcast, so none of them is one task; they are at most ``MOST_HOT`` by their count."""
    most = max(hot_rows, left.count() // MOST_HOT)
    hot = materialize(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*on), "hot")
    if hot.isEmpty():
        return left.join(right, on)
    few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    return left.join(few, on).unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))


#: Largest list of ids that is sent to every worker by ``without``, at 16 bytes an id.
HELD_IDS = 4_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` but for the rows whose id is in ``ids`` (one column, ``id``), which is written first and counted:
    a short list is broadcast, a longer one joined. Rows with a null id stay."""
    gone = materialize(ids.distinct(), "ids")
    few = F.broadcast(gone) if gone.count() <= HELD_IDS else gone
    return docs.join(few, docs[f"`{id_col}`"].cast("long") == few["id"], "left_anti")
