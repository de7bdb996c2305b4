"""A full build: every model is written once, in the order of its inputs, and read from there by the models above it."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.incremental import recent_months, write_months
from lakeloom.plans.oracle import COLUMNS
from lakeloom.plans.warehouse import MODELS, Warehouse
from lakeloom.sources.tables import create_as, create_view, exists, replace, size

#: Models that are views over their input, and those rebuilt by month, with the time that decides the month.
VIEWS = ("product_fct_sessions_v1", "finance_fct_revenue_v0", "sales_dim_customers_old_crm")
BY_MONTH = {"sales_fct_orders": "ordered_at", "sales_fct_order_items": "ordered_at", "marketing_fct_sessions": "started_at", "finance_fct_revenue": "recognized_at"}


def sort_key(name: str) -> list[str]:
    """The first column, and of rollups the dimension after the period."""
    columns = [c.split(":")[0] for c in COLUMNS[name].split()] if name in COLUMNS else []
    return columns[: 2 if "_rpt_" in name else 1]


class Build(Warehouse):
    """Models as tables below a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str, full: bool = True):
        super().__init__(spark, sf_dir)
        self.folder, self.full, self.statuses = folder.rstrip("/"), full, {}
        self.started: list[tuple[str, str]] = []  # model and scheduler pool, in the order they began
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)

    def __call__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._plans:
                self._plans[name] = self._built(name)
        return self._plans[name]

    def current(self, name: str) -> DataFrame:
        """Newest versions are found once, not by every model that reads them."""
        with self._locks[f"current {name}"]:
            key = f"current_{name}"
            if key not in self._plans:
                self._plans[key] = create_as(super().current(name), f"{self.folder}/{key}")
        return self._plans[key]

    def priced(self) -> DataFrame:
        return self("int_orders_enriched")  # a table that is there anyway

    def _built(self, name: str) -> DataFrame:
        rows, path = MODELS[name](self), f"{self.folder}/{name}"
        self.started.append((name, self.spark.sparkContext.getLocalProperty("spark.scheduler.pool") or "default"))
        self.statuses[name] = "success"
        if name in VIEWS:
            return create_view(rows, name)
        if name not in BY_MONTH:
            return create_as(rows, path, sort_key(name))
        time = BY_MONTH[name]
        if self.full or not exists(self.spark, path):
            replace(rows.withColumn("ym", F.date_format(time, "yyyyMM")).limit(0), path)  # an empty table to fill
            write_months(rows, path, time)
        else:
            newest = F.broadcast(rows.agg(F.max(time).alias("_newest")))  # one row
            write_months(recent_months(rows.crossJoin(newest), time, F.col("_newest")).drop("_newest"), path, time)
        return self.spark.read.parquet(path).drop("ym").select(*rows.columns)


def largest_first(spark: SparkSession, sf_dir: str, folder: str, names: Iterable[str]) -> list[str]:
    """Models by the bytes that they took in the last build; where there was none, by the bytes their plan reads."""
    plans = Warehouse(spark, sf_dir)

    def measured(name: str) -> int:
        taken = size(spark, f"{folder.rstrip('/')}/{name}")
        return taken or int(plans(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())

    return sorted(names, key=lambda n: (-measured(n), n))


def build(spark: SparkSession, sf_dir: str, folder: str, names: Iterable[str] | None = None, threads: int = 4, full: bool = True) -> Build:
    """Builds models (all, if none are named); those whose inputs are ready run side by side, each worker in a scheduler
    pool of its own, so that under fair scheduling a small model is not queued behind a large one's tasks. If the folder
    has a build, the models that took most are begun first."""
    out = Build(spark, sf_dir, folder, full)
    names = list(names) if names is not None else list(MODELS)
    if any(exists(spark, f"{out.folder}/{n}") for n in names):
        names = largest_first(spark, sf_dir, folder, names)
    pools = iter(range(threads))
    with ThreadPoolExecutor(threads, initializer=lambda: spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"build-{next(pools)}")) as pool:
        list(pool.map(out, names))
    return out
