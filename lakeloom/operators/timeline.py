"""Scans along a time line that one busy key cannot hold up: the line is cut into ranges, ranges are scanned side by
side, and what crosses a border is carried over from a row per range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import stored


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows with _range: ranges of about equal size of (key, time), written down, since their sampled borders must
    not move. A key with many rows spans many ranges, rows that share all values of the order one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), label)


def within(by: Sequence[str], order: Sequence[str]):
    """The window over a key's rows of one range, in order."""
    return W.partitionBy("_range", *by).orderBy(*order)


def earlier(by: Sequence[str]):
    """The window over a key's ranges before this one: a row a range."""
    return W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)


def beside(rows: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row with what its key's range (a row of ``ranges``) brings; a null key is a key."""
    names = ["_range", *by]
    other = ranges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], *[c for c in ranges.columns if c not in names])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)])
    return rows.join(other, same, "left").drop(*[f"_k{i}" for i in range(len(names))])


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the newest ``value`` that is not null up to each row of its key, in ascending order."""
    rows = dealt(rows, by, order, "carried")
    newest = F.max_by(value, F.struct(*order))
    ends = rows.where(F.col(value).isNotNull()).groupBy("_range", *by).agg(newest.alias("_end"))
    every = rows.select("_range", *by).distinct()
    ends = beside(every, ends, by).withColumn("_before", F.last("_end", ignorenulls=True).over(earlier(by))).drop("_end")
    here = F.last(value, ignorenulls=True).over(within(by, order).rowsBetween(W.unboundedPreceding, 0))
    return beside(rows.withColumn("_here", here), ends, by).withColumn(name, F.coalesce("_here", "_before")).drop("_here", "_before", "_range")


def queued(rows: DataFrame, by: str, start: str, id: str, takes: str) -> DataFrame:
    """Rows (with _range) as a queue a key serves one after another: end, where each is done, and _free, when the one
    before it was (null for a key's first). ``end`` of the nth is c(n) + max over i <= n of (start(i) - c(i-1)), c being
    the sum of times taken: a scan under (max, +), so ranges give a sum and a maximum, and these are scanned once more."""
    rows = dealt(rows, [by], [start, id], "queued")
    line = within([by], [start, id])
    rows = rows.withColumn("_c", F.sum(takes).over(line.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_x", F.max(F.col(start) - (F.col("_c") - F.col(takes))).over(line.rowsBetween(W.unboundedPreceding, 0)))
    rows = stored(rows.withColumn("_lag", F.lag("_x").over(line)), "queued-ranges")
    ranges = rows.groupBy("_range", by).agg(F.sum(takes).alias("_sum"), F.max("_x").alias("_top"))
    ranges = ranges.withColumn("_p", F.coalesce(F.sum("_sum").over(earlier([by])), F.lit(0)))
    ranges = ranges.withColumn("_g", F.max(F.col("_top") - F.col("_p")).over(earlier([by]))).drop("_sum", "_top")
    end = lambda c, x: F.col("_p") + c + F.greatest(F.col("_g"), x - F.col("_p"))  # noqa: E731  # greatest() skips nulls
    out = beside(rows, ranges, [by]).withColumn("end_ms", end(F.col("_c"), F.col("_x")))
    return out.withColumn("_free", end(F.col("_c") - F.col(takes), F.col("_lag"))).drop("_c", "_x", "_lag", "_p", "_g")


def numbered_runs(rows: DataFrame, by: str, start: str, id: str, fresh: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows up to this one of its key (with _range) were ``fresh``, each of which begins a run."""
    rows = rows.withColumn("_new", fresh.cast("int"))
    ranges = rows.groupBy("_range", by).agg(F.sum("_new").alias("_runs"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_runs").over(earlier([by])), F.lit(0))).drop("_runs")
    here = F.sum("_new").over(within([by], [start, id]).rowsBetween(W.unboundedPreceding, 0))
    return beside(rows.withColumn("_here", here), ranges, [by]).withColumn(name, F.col("_here") + F.col("_before")).drop("_new", "_here", "_before", "_range")
