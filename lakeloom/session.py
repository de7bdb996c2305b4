"""Sessions with the settings the engine's plans assume."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lakeloom")
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only where that is unset, as in tests, a folder of
    this machine takes its place."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        path = tempfile.mkdtemp(prefix="lakeloom-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: lineage ends here and survives a lost executor."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``stored`` wrote; nothing may read these tables any more."""
    for rows in written:
        path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rows._written_to)
        path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
