"""Shared pieces of the corpus operators: table access, lineage cuts, names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch. Texts are thousands of bytes, and the usual 10,000 rows of them fill an executor.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold ``BATCH_ROWS`` rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; Spark itself opens the path, so any file system will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. ``spark.checkpoint.dir`` names it; where that is unset (a single
    machine, as in tests) a temporary folder takes its place."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = tempfile.mkdtemp(prefix="lakeloom-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. This cuts lineage, fixes sampled range
    boundaries, and survives a lost executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing may read these tables any more."""
    for df in written:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def only(key, make):
    """``make()``, kept in this worker process until another thing is asked for: workers live on from stage to stage,
    and what one operator keeps would add up with what the next one needs."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give back memory that this worker process holds without using it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # not every C library has it


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; operators derive bucket counts from it, so that they follow the cluster."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(column: str = "doc_id"):
    """An id as text: pandas would turn a column of longs that holds a null into doubles and lose digits."""
    return F.col(column).cast("long").cast("string")


def whole_text(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
