"""Exact distinct counts that roll up: a day's ids are kept as bits, and longer periods join bits instead of reading the
rows again. A bitmap covers 32,768 neighbouring ids (4 KB), so ids should be numbers without large gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily(rows: DataFrame, by: Sequence[str], day: Column, id: str) -> DataFrame:
    """by, day, _block, _bits: which ids a day holds; nulls are left out, as in any distinct count."""
    rows = rows.where(F.col(id).isNotNull()).select(*by, day.alias("day"), F.bitmap_bucket_number(id).alias("_block"), F.bitmap_bit_position(id).alias("_at"))
    return rows.groupBy(*by, "day", "_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def rolled(days: DataFrame, by: Sequence[str], period: Column) -> DataFrame:
    """by, period, n: exact distinct ids of longer periods (or fewer groups), from the days' bits."""
    blocks = days.groupBy(*by, period.alias("period"), "_block").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return blocks.groupBy(*by, "period").agg(F.sum(F.bitmap_count("_bits")).alias("n"))
