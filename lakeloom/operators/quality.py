"""Data-quality tests. Each returns the failing rows (none: the test passes), as a lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_age(rows: DataFrame, loaded_at: str, days: int, anchor: Column | None = None) -> DataFrame:
    """Rows of the last ``days + 1`` spans of 24 hours before the newest load, with ``_day`` (0 is the newest)."""
    clock = F.broadcast(rows.agg((F.max(loaded_at) if anchor is None else anchor).alias("_anchor")))  # one row
    age = F.floor((F.unix_micros(F.col("_anchor").cast("timestamp")) - F.unix_micros(F.col(loaded_at).cast("timestamp"))) / 86_400_000_000)
    return rows.crossJoin(clock).withColumn("_day", age).where(F.col("_day").between(0, days))


def recent_volume(rows: DataFrame, loaded_at: str, min_share: float = 0.5, days: int = 7, min_usual: int = 10) -> DataFrame:
    """today, usual: if the newest day has under ``min_share`` of the median of the days before (empty days are 0)."""
    daily = with_age(rows, loaded_at, days).groupBy("_day").agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(days + 1).select(F.col("id").alias("_day"))
    filled = spine.join(F.broadcast(daily), "_day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    both = filled.agg(F.sum(F.when(F.col("_day") == 0, F.col("n"))).alias("today"), F.expr("percentile(n, 0.5) FILTER (WHERE _day > 0)").alias("usual"))
    return both.where((F.col("usual") >= min_usual) & (F.col("today") < min_share * F.col("usual")))


def null_profile(rows: DataFrame, loaded_at: str, columns: Sequence[str], days: int = 7, margin: float = 0.2, min_z: float = 4, min_rows: int = 10) -> DataFrame:
    """column_name, today_share, usual_share: columns whose share of nulls rose by more than margin and chance.
    One pass over the rows for all columns."""
    aged = with_age(rows, loaded_at, days)
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    daily = aged.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"), *shares)
    long = daily.select("_day", "_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in columns])).alias("x"))
    both = long.groupBy("x.column_name").agg(
        F.max(F.when(F.col("_day") == 0, F.col("_n"))).alias("_n"),
        F.max(F.when(F.col("_day") == 0, F.col("x.share"))).alias("today_share"),
        F.expr("percentile(x.share, 0.5) FILTER (WHERE _day > 0)").alias("usual_share"),
    )
    rise, usual = F.col("today_share") - F.col("usual_share"), F.col("usual_share")
    chance = min_z * F.sqrt(F.greatest(usual * (1 - usual), F.lit(1e-9)))
    return both.where((F.col("_n") >= min_rows) & (rise > margin) & (rise * F.sqrt("_n") > chance)).drop("_n")


def new_values(rows: DataFrame, loaded_at: str, column: str, days: int = 7, share: float = 0.1, max_distinct: int = 50, min_rows: int = 10) -> DataFrame:
    """today_rows, new_rows: if too many of the newest rows carry a value of a small text column not seen before."""
    by_value = with_age(rows, loaded_at, days).where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count_if(F.col("_day") == 0).alias("_today"), F.count_if(F.col("_day") > 0).alias("_before")
    )
    out = by_value.agg(
        F.sum("_today").alias("today_rows"),
        F.coalesce(F.sum(F.when(F.col("_before") == 0, F.col("_today"))), F.lit(0)).alias("new_rows"),
        F.count_if(F.col("_before") > 0).alias("_known"),
    )
    few = F.col("_known").between(1, max_distinct) & (F.col("today_rows") >= min_rows)
    return out.where(few & (F.col("new_rows") > share * F.col("today_rows"))).drop("_known")


def row_count_in_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).where(~F.col("n_rows").between(low, high))


def unique_combination(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def not_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull())


def non_negative(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column) < 0)


def accepted_values(rows: DataFrame, column: str, *values) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def freshness(rows: DataFrame, loaded_at: str, now: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """max_loaded_at, age_hours, status of a source at a given time."""
    newest = rows.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("max_loaded_at").cast("timestamp"))) / 3600
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return newest.withColumn("age_hours", age).withColumn("status", status)
