"""Column functions for exact money, rounding and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def avg_half_up(c: ColumnLike, scale: int = 2) -> Column:
    """Mean of the non-null values, computed in decimals and rounded half away from zero; null without values."""
    total = F.sum(col(c).cast("decimal(18,6)")).cast("decimal(22,6)")
    n = F.nullif(F.count(col(c)), F.lit(0)).cast("decimal(12,0)")  # leaves the quotient 19 decimals
    return F.round(total / n, scale).cast(f"decimal(18,{scale})")


def ratio(num: ColumnLike, den: ColumnLike, scale: int = 4) -> Column:
    """Quotient in double precision, rounded; null where the denominator is 0."""
    return F.round(col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0)), scale)


def boundaries(unit: str, start: ColumnLike, end: ColumnLike) -> Column:
    """How many borders of ``unit`` (minute, hour, day, month) lie between two times: both are truncated first."""
    a, b = (F.date_trunc(unit, col(c)) for c in (start, end))
    if unit == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    return F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / seconds).cast("long")


def period(grain: str, c: ColumnLike) -> Column:
    """First day of the day, week (from Monday) or month of a time."""
    return F.to_date(F.date_trunc({"daily": "day", "weekly": "week", "monthly": "month"}.get(grain, grain), col(c)))
