"""Exact cost allocation, warehouse pricing and usage advice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import selection, timeline
from lakeloom.session import stored

UNIT = 10**12  # money is counted in whole units of 1e-12
BIG = "decimal(38,0)"
CONSUMERS = ("dashboard", "adhoc")


class PricingModel(Protocol):
    """Anything that prices queries: query_id and usd of the records it is given."""

    name: str

    def price(self, records: DataFrame) -> DataFrame: ...


class ScanPricing:
    """By bytes read, every table at least the minimum."""

    name = "scan"

    def __init__(self, least: int = 10 << 20, usd_per_tib: float = 6.25):
        self.least, self.usd_per_tib = least, usd_per_tib

    def price(self, records: DataFrame) -> DataFrame:
        return scan_price(records, "query_id", "table_bytes", self.least, self.usd_per_tib).select("query_id", "usd")


class WarehousePricing:
    """By the seconds warehouses run, each burst's price dealt out over its queries by their running time. A query runs
    on the warehouse of its kind of work."""

    name = "compute"

    def __init__(self, warehouses: dict[str, str], idle_ms: int = 300_000, least_seconds: int = 60, usd_per_hour: float = 3.0):
        self.warehouses, self.idle_ms, self.least_seconds, self.usd_per_hour = warehouses, idle_ms, least_seconds, usd_per_hour

    def price(self, records: DataFrame) -> DataFrame:
        place = F.create_map(*[F.lit(x) for pair in self.warehouses.items() for x in pair])
        rows = records.select("query_id", F.coalesce(F.element_at(place, F.col("actor_type")), F.lit("default")).alias("warehouse"), F.unix_millis(F.col("started_at").cast("timestamp")).alias("start"), F.col("modeled_ms").alias("ms"))
        runs = bursts(rows, "warehouse", "start", "query_id", "ms", self.idle_ms)
        return burst_shares(runs, bill(runs, "warehouse", "ms", self.idle_ms, self.least_seconds, self.usd_per_hour))


def burst_shares(runs: DataFrame, bills: DataFrame) -> DataFrame:
    """query_id, usd: each burst's price dealt out over its queries by their milliseconds, exactly."""
    rows = runs.select("query_id", "warehouse", "burst", "ms").join(bills.select("warehouse", "burst", F.col("usd").cast("decimal(25,12)").alias("_usd")), ["warehouse", "burst"])
    return share(rows, "_usd", "ms", ["warehouse", "burst"], "query_id").select("query_id", "usd")


def month_pools(days: DataFrame, day: str, monthly: Column) -> DataFrame:
    """A stated monthly price per month, in proportion to the days present."""
    month, length = F.date_format(day, "yyyy-MM"), F.dayofmonth(F.last_day(day))
    rows = days.select(month.alias("month"), length.alias("_length")).groupBy("month", "_length").agg(F.count(F.lit(1)).alias("days"))
    # narrow types: Spark gives a quotient fewer digits where the types could overflow
    priced = (monthly.cast("decimal(20,6)") * F.col("days").cast("decimal(4,0)")).cast("decimal(31,12)") / F.col("_length").cast("decimal(2,0)")
    return rows.select("month", "days", F.round(priced, 12).cast("decimal(30,12)").alias("usd"))


def with_group(rows: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """The rows with aggregates of their group: partial sums and a join, so no group meets in one task (as a window
    would have it)."""
    of = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(*aggregates)
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(of[f"_g{i}"]) for i, c in enumerate(by)])
    return rows.join(of, same).drop(*[f"_g{i}" for i in range(len(by))])


def share(rows: DataFrame, total: str, weight: str, by: Sequence[str], key: str, down: bool = False) -> DataFrame:
    """Adds ``usd``: the group's ``total`` in proportion to whole-number weights, rounded to 1e-12 half to even (or
    down), the rest going to the largest weight (of equal ones to the first key), so that shares sum exactly. A key
    stands in its group once. Weights of 0 or less get no row. Only whole multiples are divided, so quotients are exact."""
    live = rows.where(F.col(weight) > 0).withColumn("_pool", (F.col(total).cast("decimal(25,12)") * F.lit(UNIT)).cast(BIG))
    rank = F.struct((-F.col(weight)).alias("w"), F.col(key).alias("k"))
    live = with_group(live, by, F.sum(F.col(weight).cast(BIG)).cast(BIG).alias("_sum"), F.min(rank).alias("_top"))
    product = (F.col("_pool") * F.col(weight).cast("decimal(18,0)")).cast(BIG)
    live = live.withColumn("_p", product).withColumn("_rem", F.col("_p") % F.col("_sum"))
    live = live.withColumn("_floor", ((F.col("_p") - F.col("_rem")).cast(BIG) / F.col("_sum")).cast(BIG))
    up = F.lit(0) if down else F.when((2 * F.col("_rem") > F.col("_sum")) | ((2 * F.col("_rem") == F.col("_sum")) & (F.col("_floor") % 2 == 1)), 1).otherwise(0)
    live = live.withColumn("_units", (F.col("_floor") + up).cast(BIG))
    live = with_group(live, by, F.sum("_units").cast(BIG).alias("_all"))
    units = F.col("_units") + F.when(F.col("_top") == rank, F.col("_pool") - F.col("_all")).otherwise(F.lit(0))
    usd = (units.cast("decimal(22,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(30,12)")
    return live.withColumn("usd", usd).drop("_sum", "_top", "_pool", "_p", "_rem", "_floor", "_units", "_all")


def bursts(queries: DataFrame, warehouse: str, started_ms: str, id: str, ms: str, idle_ms: int) -> DataFrame:
    """Adds end_ms and burst: queries of a warehouse run one after another, and a burst ends when none was submitted
    within the idle time. Queue and numbering are scans over time ranges, so a warehouse with all queries is spread over
    tasks."""
    rows = timeline.queued(queries, warehouse, started_ms, id, ms)
    fresh = F.coalesce(F.col(started_ms) > F.col("_free") + idle_ms, F.lit(True))
    return timeline.numbered_runs(rows, warehouse, started_ms, id, fresh, "burst").drop("_free")


def bill(runs: DataFrame, warehouse: str, ms: str, idle_ms: int, least_seconds: int, usd_per_hour: float) -> DataFrame:
    """Seconds and price per burst: the span with the idle time, at least the minimum."""
    spans = runs.groupBy(warehouse, "burst").agg(F.count(F.lit(1)).alias("n_queries"), F.sum(ms).alias("busy_ms"), F.min(F.col("end_ms") - F.col(ms)).alias("_start"), F.max("end_ms").alias("_end"))
    seconds = F.greatest(F.lit(least_seconds), F.ceil((F.col("_end") - F.col("_start") + idle_ms) / 1000)).cast("long")
    return spans.withColumn("seconds", seconds).withColumn("usd", F.round(F.col("seconds") * usd_per_hour / 3600, 6)).drop("_start", "_end")


def scan_price(queries: DataFrame, id: str, table_bytes: str, least: int = 10 << 20, usd_per_tib: float = 6.25) -> DataFrame:
    """Price of each query: every table read counts at least the minimum."""
    each = queries.select(id, F.explode(table_bytes).alias("_b")).groupBy(id).agg(F.sum(F.greatest(F.col("_b"), F.lit(least))).alias("billed_bytes"))
    return each.withColumn("usd", F.round(F.col("billed_bytes") * usd_per_tib / float(1 << 40), 9))


def two_figures_up(x: Column) -> Column:
    """Rounded up to two significant figures."""
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10(x.cast("double"))) - 1))
    return (F.ceil(x / step) * step).cast("long")


def quotas(reads: DataFrame, user: str, started_at: str, size: str, headroom: int = 2) -> DataFrame:
    """user, active_days, p95_daily, max_query, daily_quota, query_limit: some times the 95th percentile of a user's
    days and some times the largest single query, rounded up to two figures. ``reads`` has a row a query."""
    daily = reads.groupBy(F.col(user).alias("user"), F.to_date(started_at).alias("_day")).agg(F.sum(size).alias("_n"), F.max(size).alias("_max"))
    daily = stored(daily, "daily-reads")
    rows = daily.groupBy("user").agg(F.count(F.lit(1)).alias("active_days"), F.max("_max").alias("max_query"))
    usual = selection.quantile(daily, ["user"], "_n", (95, 100)).select(F.col("user").alias("_user"), F.col("_n").alias("p95_daily"))
    rows = rows.join(usual, F.col("user").eqNullSafe(F.col("_user"))).drop("_user")
    limit = lambda c: F.when(F.col(c) <= 0, F.lit(0).cast("long")).otherwise(two_figures_up(headroom * F.col(c)))
    return rows.withColumns({"daily_quota": limit("p95_daily"), "query_limit": limit("max_query")})


def hotspots(reads: DataFrame, tables: DataFrame, share_of_rows: float = 0.9, least_bytes: int = 0, least_reads: int = 2) -> DataFrame:
    """table_name, filter_column, reads, rows, bytes, suggestion: filters with which people and dashboards still read
    nearly the whole of the one table of their query. ``reads`` has actor_type, tables, rows_scanned, bytes_scanned,
    filter_columns; ``tables`` table_name, table_rows, table_bytes, sorting_key, engine."""
    mine = reads.where(F.col("actor_type").isin(*CONSUMERS) & (F.size("tables") == 1)).withColumn("table_name", F.get("tables", F.lit(0)))
    full = mine.join(tables, "table_name").where((F.col("table_rows") > 0) & (F.col("rows_scanned") >= share_of_rows * F.col("table_rows")) & (F.col("table_bytes") >= least_bytes))
    by = full.select("table_name", "sorting_key", "engine", "rows_scanned", "bytes_scanned", F.explode("filter_columns").alias("filter_column"))
    by = by.groupBy("table_name", "filter_column", "sorting_key", "engine")
    found = by.agg(F.count(F.lit(1)).alias("reads"), F.sum("rows_scanned").alias("rows"), F.sum("bytes_scanned").alias("bytes")).where(F.col("reads") >= least_reads)
    return found.withColumn("suggestion", sort_advice("filter_column", "sorting_key", "engine")).drop("sorting_key", "engine")


def sort_advice(column: str, sorting_key: str, engine: str) -> Column:
    """Put the column first in the sort key, unless the engine deduplicates by the key: then a skip index."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(sorting_key, r"^\(+|\)+$", ""), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != F.col(column)))
    key = F.concat(F.lit("sort key ("), F.array_join(F.concat(F.array(F.col(column)), parts), ", "), F.lit(")"))
    return F.when(F.col(engine).startswith("Replacing"), F.concat(F.lit("skip index on "), F.col(column))).otherwise(key)
