"""Loads by high watermark, month rebuilds, versions and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load_window(rows: DataFrame, changed_at: str, mark: Column | None, until: Column, overlap: str = "60 MINUTES") -> DataFrame:
    """Rows changed in (mark - overlap, until]; all up to ``until`` if there is no mark. Re-read rows are versions
    that the latest-version read folds; rows later than the overlap are lost, as with any watermark."""
    upper = F.col(changed_at) <= until
    return rows.where(upper if mark is None else upper & (F.col(changed_at) > mark - F.expr(f"INTERVAL {overlap}")))


def snapshot(versions: DataFrame, key: str, changed_at: str) -> DataFrame:
    """Slowly changing dimension: each distinct version with valid_from and valid_to (null: current)."""
    rows = versions.dropDuplicates([key, changed_at])
    following = F.lead(changed_at).over(W.partitionBy(key).orderBy(changed_at))
    return rows.withColumns({"valid_from": F.col(changed_at), "valid_to": following})


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, changed_at: str) -> DataFrame:
    """The snapshot after a further load; the same load twice changes nothing."""
    return snapshot(old.drop("valid_from", "valid_to").unionByName(new), key, changed_at)


def recent_months(rows: DataFrame, time: str, newest: Column) -> DataFrame:
    """Rows of the month of ``newest`` and the month before: the partitions that an incremental build replaces."""
    return rows.where(F.trunc(time, "month") >= F.add_months(F.trunc(newest, "month"), -1))


def write_months(rows: DataFrame, path: str, time: str) -> None:
    """Overwrite the month partitions that occur in ``rows``, leaving all others."""
    out = rows.withColumn("ym", F.date_format(time, "yyyyMM"))
    out.repartition("ym").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return old.join(new, list(key), "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(key)).join(old, list(key), "left_anti"))
