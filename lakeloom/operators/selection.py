"""Exact quantiles of all groups at once, in bounded memory.

A group's wanted rank is closed in on by histograms: each round counts the rows between the group's bounds in ``WIDTH``
buckets (partial counts, a row a bucket is shuffled), picks the bucket that holds the rank and takes that bucket's least
and largest value as the new bounds. When at most ``FEW`` rows lie between the bounds, or all of them are equal, the rank
is read off. No task holds a group's values, however large the group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.session import stored

WIDTH, FEW = 1024, 4096


def matched(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows beside their group's state; a null key is a group. State columns keep their names, its keys are _g0, ..."""
    other = state.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in state.columns if c not in by])
    return rows.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.lit(True))) if by else rows.crossJoin(F.broadcast(other))


def bucket(v: str, kind: str, width: int) -> Column:
    """A number from 0 to width - 1 that does not fall as the value grows; the least value has the first to itself, the
    largest the last."""
    if kind in ("double", "float"):
        part = (F.col(v) / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves do not overflow
    else:
        wide = lambda c: F.col(c).cast("decimal(38,6)" if kind.startswith("decimal") else "decimal(20,0)")
        part = (wide(v) - wide("_lo")).cast("double") / (wide("_hi") - wide("_lo")).cast("double")
    inner = F.when(part.isNull() | F.isnan(part), F.lit(0.0)).otherwise(part) * (width - 3)
    middle = F.greatest(F.lit(1), F.least(F.lit(width - 2), 1 + F.floor(inner).cast("int")))
    return F.when(F.col(v) == F.col("_lo"), 0).when(F.col(v) == F.col("_hi"), width - 1).otherwise(middle)


def ranked(rows: DataFrame, by: Sequence[str], value: str, ranks: Column, width: int = WIDTH, few: int = FEW) -> DataFrame:
    """by, _which, _v: for each group the values of the ranks (from 1) that ``ranks``, an array in terms of _n (how many
    values the group has), names; nulls are left out. ``rows`` is read once a round, so it should be a table."""
    by, kind = list(by), rows.schema[value].dataType.simpleString()
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    state = stored(state.select(*by, "_n", "_lo", "_hi", F.posexplode(ranks).alias("_which", "_rank")), "selection")
    closed, wide = [], (F.col("_n") > few) & (F.col("_lo") != F.col("_hi"))
    while True:
        closed.append(state.where(~wide))
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        inside = matched(rows, open_, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy(*by, "_which", "_rank", bucket("_v", kind, width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        line = W.partitionBy(*by, "_which").orderBy("_b")  # at most ``width`` rows
        counts = counts.withColumn("_to", F.sum("_n").over(line)).withColumn("_from", F.col("_to") - F.col("_n"))
        held = counts.where((F.col("_from") < F.col("_rank")) & (F.col("_rank") <= F.col("_to")))
        state = stored(held.select(*by, "_n", "_lo", "_hi", "_which", (F.col("_rank") - F.col("_from")).alias("_rank")), "selection")
    last = reduce(DataFrame.unionAll, closed)
    same = last.where("_lo = _hi").select(*by, "_which", F.col("_lo").alias("_v"))
    inside = matched(rows, last.where("_lo <> _hi"), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    order = F.row_number().over(W.partitionBy(*by, "_which").orderBy("_v"))  # at most ``few`` rows
    return same.unionAll(inside.withColumn("_at", order).where("_at = _rank").select(*by, "_which", "_v"))


def with_groups(rows: DataFrame, by: Sequence[str], found: DataFrame, name: str) -> DataFrame:
    """Every group once, with null where it has no value."""
    if not by:
        return rows.sparkSession.range(1).join(found, F.lit(True), "left").select(name)
    return matched(rows.select(*by).distinct(), found, by).select(*by, name).unionAll(rows.groupBy(*by).agg(F.count(name).alias("_c")).where("_c = 0").select(*by, F.lit(None).cast(found.schema[name].dataType).alias(name)))


def quantile(rows: DataFrame, by: Sequence[str], value: str, share: tuple[int, int], width: int = WIDTH, few: int = FEW) -> DataFrame:
    """by, value: the nearest-rank quantile of a share (a fraction of whole numbers): the least value that at least that
    share of the group's values do not exceed. A group without values has null."""
    up, down = share
    rank = F.greatest(F.lit(1).cast("long"), F.expr(f"(_n * {up} + {down - 1}) div {down}"))
    found = ranked(rows, by, value, F.array(rank), width, few)
    return with_groups(rows, by, found.select(*by, F.col("_v").alias(value)), value)


def median(rows: DataFrame, by: Sequence[str], value: str, width: int = WIDTH, few: int = FEW) -> DataFrame:
    """by, value: the middle value, of an even number the mean of the two (a double)."""
    found = ranked(rows, by, value, F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")), width, few)
    found = found.groupBy(*by).agg(F.avg(F.col("_v").cast("double")).alias(value))
    return with_groups(rows, by, found, value)
