"""A shop's raw tables made from nothing but a seed, with daily arrivals, faults, and a workload.

Every value is an expression of the row's number and hashes of it, so a table of any size is one map over
``spark.range``, the same on every machine; no row depends on another.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.incidents import stable_hash
from lakeloom.sources import tables

#: Rows at scale 1 (customers without those who register twice).
ROWS = {"customers": 47_842, "products": 2_000, "orders": 400_000, "order_items": 1_200_000, "payments": 372_000, "web_sessions": 1_450_000, "marketing_campaigns": 80, "marketing_spend": 10_000, "support_tickets": 27_000}
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "payments": "payment_id", "web_sessions": "session_id", "marketing_campaigns": "campaign_id", "marketing_spend": "spend_id", "support_tickets": "ticket_id"}
START, DAYS = datetime(2024, 1, 1), 730
COUNTRIES = ("US", "GB", "DE", "FR", "CA", "AU", "NL", "SE", "ES", "IT")


@dataclass(frozen=True)
class Generator:
    spark: SparkSession
    scale: float = 0.01
    seed: int = 42

    def n(self, table: str) -> int:
        return max(10, round(ROWS[table] * self.scale))

    def h(self, table: str, column: str, row: Column | str = "i") -> Column:
        """A hash that table, column and row fix."""
        return F.xxhash64(F.lit(self.seed), F.lit(table), F.lit(column), F.col(row) if isinstance(row, str) else row)

    def u(self, table: str, column: str, row: Column | str = "i") -> Column:
        """Uniform in [0, 1)."""
        return F.pmod(self.h(table, column, row), F.lit(1_000_000)) / F.lit(1_000_000.0)

    def pick(self, table: str, column: str, values: Sequence[str | None]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(self.h(table, column), F.lit(len(values))).cast("int"))

    def shares(self, table: str, column: str, shares: Mapping[str, float]) -> Column:
        """Values with shares of the rows; the last takes the rest."""
        at, total, out = self.u(table, column), 0.0, None
        names = list(shares)
        for v in names[:-1]:
            total += shares[v]
            out = F.when(at < total, v) if out is None else out.when(at < total, v)
        return out.otherwise(names[-1]) if out is not None else F.lit(names[0])

    def between(self, table: str, column: str, low: int, high: int, row: Column | str = "i") -> Column:
        return F.lit(low) + F.pmod(self.h(table, column, row), F.lit(high - low + 1))

    def moment(self, table: str, column: str = "at", row: Column | str = "i") -> Column:
        """A second of the window."""
        seconds = F.pmod(self.h(table, column, row), F.lit(DAYS * 86_400))
        return (F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("timestamp_ntz")

    def later(self, time: Column, seconds: Column) -> Column:
        return (time.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("timestamp_ntz")

    def cents(self, table: str, column: str, low: int, high: int) -> Column:
        return (self.between(table, column, low, high).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")

    def rows(self, table: str) -> DataFrame:
        return self.spark.range(1, self.n(table) + 1).withColumnRenamed("id", "i")

    def customers(self) -> DataFrame:
        """One in fifty registers twice: the same e-mail but for case or white space, a new id, some days later."""
        t, n = "customers", self.n("customers")
        base = self.rows(t).select(
            F.col("i").alias("customer_id"), self.pick(t, "first", ("Ada", "Ben", "Cleo", "Dov", "Eli")).alias("first_name"), self.pick(t, "last", ("Ito", "Kim", "Lee", "May")).alias("last_name"),
            F.concat(F.lit("user"), F.col("i").cast("string"), F.lit("@example.com")).alias("email"), F.when(self.u(t, "phone") < 0.8, F.concat(F.lit("+1-555-"), F.lpad(F.col("i").cast("string"), 7, "0"))).alias("phone"),
            self.pick(t, "country", COUNTRIES).alias("country"), F.when(self.u(t, "referred") < 0.7, self.pick(t, "referral", ("search", "friend", "ad", "blog"))).alias("referral_source"), self.moment(t).alias("signed_up_at"),
        )
        k = F.col("k")
        again = self.spark.range(1, max(1, n // 50) + 1).withColumnRenamed("id", "k").withColumn("_of", 1 + F.pmod(self.h(t, "dup_of", k), F.lit(n)))
        again = again.join(base, again["_of"] == base["customer_id"])
        form = F.pmod(self.h(t, "dup_form", k), F.lit(3))
        email = F.when(form == 0, F.upper("email")).when(form == 1, F.concat(F.lit("  "), "email")).otherwise(F.concat("email", F.lit(" ")))
        days = self.between(t, "dup_days", 1, 60, k) * 86_400
        again = again.select((n + k).alias("customer_id"), "first_name", "last_name", email.alias("email"), F.lit(None).cast("string").alias("phone"), "country", "referral_source", self.later(F.col("signed_up_at"), days).alias("signed_up_at"))
        return base.unionByName(again)

    def products(self) -> DataFrame:
        t = "products"
        price = self.cents(t, "price", 500, 50_000)
        return self.rows(t).select(
            F.col("i").alias("product_id"), F.concat(F.lit("Product "), F.col("i").cast("string")).alias("product_name"), self.pick(t, "category", ("toys", "home", "books", "garden", "music")).alias("category"),
            price.alias("unit_price"), (price * F.lit("0.60").cast("decimal(3,2)")).cast("decimal(12,2)").alias("unit_cost"), (self.u(t, "active") < 0.9).alias("is_active"), self.moment(t).alias("created_at"),
        )

    def orders(self) -> DataFrame:
        t = "orders"
        return self.rows(t).select(
            F.col("i").alias("order_id"), self.between(t, "customer", 1, self.n("customers")).alias("customer_id"), self.moment(t).alias("ordered_at"),
            self.shares(t, "status", {"completed": 0.84, "shipped": 0.04, "pending": 0.03, "cancelled": 0.05, "returned": 0.04}).alias("status"),
            self.shares(t, "channel", {"web": 0.5, "mobile": 0.38, "store": 0.12}).alias("channel"),
            F.when(self.u(t, "discounted") < 0.15, self.pick(t, "code", ("SAVE5", "SAVE10"))).alias("discount_code"), F.lit("USD").alias("currency"),
        )

    def order_items(self) -> DataFrame:
        t = "order_items"
        order = 1 + F.pmod(F.col("i") - 1, F.lit(self.n("orders")))
        return self.rows(t).select(
            F.col("i").alias("order_item_id"), order.alias("order_id"), (1 + F.expr(f"(i - 1) DIV {self.n('orders')}")).cast("int").alias("line_number"),
            self.between(t, "product", 1, self.n("products")).alias("product_id"), self.between(t, "quantity", 1, 5).cast("int").alias("quantity"), self.cents(t, "price", 500, 50_000).alias("unit_price"), self.moment("orders", "at", order).alias("_changed_at"),
        )

    def payments(self) -> DataFrame:
        """Three in a hundred orders are paid in two parts; one payment in twenty arrives days late."""
        t = "payments"
        order = 1 + F.pmod(F.col("i") - 1, F.lit(self.n("orders")))
        paid = self.later(self.moment("orders", "at", order), self.between(t, "delay", 0, 3_600))
        late = F.when(self.u(t, "late") < 0.05, self.between(t, "late_days", 1, 5) * 86_400).otherwise(F.lit(0))
        return self.rows(t).select(
            F.col("i").alias("payment_id"), order.alias("order_id"), self.pick(t, "method", ("card", "paypal", "transfer")).alias("payment_method"),
            self.shares(t, "status", {"succeeded": 0.95, "failed": 0.03, "refunded": 0.02}).alias("status"),
            F.when(self.u(t, "split") < 0.03, self.cents(t, "part", 100, 2_000)).otherwise(self.cents(t, "amount", 500, 90_000)).alias("amount"), paid.alias("created_at"), self.later(paid, late).alias("_changed_at"),
        )

    def web_sessions(self) -> DataFrame:
        t = "web_sessions"
        campaign = F.when(self.u(t, "utm") < 0.4, self.between(t, "campaign", 1, self.n("marketing_campaigns")))
        return self.rows(t).select(
            F.col("i").alias("session_id"), F.when(self.u(t, "known") < 0.45, self.between(t, "customer", 1, self.n("customers"))).alias("customer_id"), self.moment(t).alias("started_at"),
            self.pick(t, "device", ("desktop", "mobile", "tablet")).alias("device"), self.pick(t, "page", ("/", "/sale", "/new")).alias("landing_page"),
            F.when(campaign.isNotNull(), self.pick(t, "source", ("google", "facebook", "email"))).alias("utm_source"), campaign.alias("campaign_id"),
            self.between(t, "views", 1, 20).cast("int").alias("pageviews"), self.between(t, "seconds", 5, 1_800).cast("int").alias("duration_seconds"), (self.u(t, "converted") < 0.03).alias("converted"),
        )

    def marketing_campaigns(self) -> DataFrame:
        t = "marketing_campaigns"
        start = F.to_date(self.moment(t))
        return self.rows(t).select(
            F.col("i").alias("campaign_id"), F.concat(F.lit("Campaign "), F.col("i").cast("string")).alias("campaign_name"), self.pick(t, "channel", ("email", "search", "social", "display")).alias("channel"),
            start.alias("start_date"), F.date_add(start, self.between(t, "days", 14, 120).cast("int")).alias("end_date"), self.cents(t, "budget", 100_000, 5_000_000).alias("budget"),
        )

    def marketing_spend(self) -> DataFrame:
        t = "marketing_spend"
        shown = self.between(t, "impressions", 100, 50_000)
        return self.rows(t).select(
            F.col("i").alias("spend_id"), self.between(t, "campaign", 1, self.n("marketing_campaigns")).alias("campaign_id"), F.to_date(self.moment(t)).alias("spend_date"),
            self.cents(t, "spend", 1_000, 90_000).alias("spend"), shown.alias("impressions"), F.floor(shown * self.u(t, "rate") * 0.1).alias("clicks"),
        )

    def support_tickets(self) -> DataFrame:
        t = "support_tickets"
        opened = self.moment(t)
        solved = F.when(self.u(t, "solved") < 0.85, self.later(opened, self.between(t, "hours", 1, 200) * 3_600))
        return self.rows(t).select(
            F.col("i").alias("ticket_id"), self.between(t, "customer", 1, self.n("customers")).alias("customer_id"), F.when(self.u(t, "about") < 0.6, self.between(t, "order", 1, self.n("orders"))).alias("order_id"),
            self.pick(t, "category", ("delivery", "returns", "billing")).alias("category"), self.pick(t, "priority", ("low", "normal", "high", "urgent")).alias("priority"),
            F.when(solved.isNull(), "open").otherwise("closed").alias("status"), opened.alias("created_at"), solved.alias("resolved_at"),
            F.when(solved.isNotNull() & (self.u(t, "rated") < 0.5), self.between(t, "score", 1, 5).cast("int")).alias("satisfaction_score"),
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def changed_at(self, name: str) -> Column:
        """When a row reaches the shop's database."""
        times = {"customers": "signed_up_at", "products": "created_at", "orders": "ordered_at", "order_items": "_changed_at", "payments": "_changed_at", "web_sessions": "started_at", "marketing_campaigns": "start_date", "marketing_spend": "spend_date", "support_tickets": "created_at"}
        return F.col(times[name]).cast("timestamp_ntz")

    def arrivals(self, name: str, day: datetime) -> DataFrame:
        """What one day brings: the rows that are new, and older orders and tickets that change in place."""
        rows, at = self.table(name), self.changed_at(name)
        of = lambda d: (at >= F.lit(d).cast("timestamp_ntz")) & (at < F.lit(d + timedelta(days=1)).cast("timestamp_ntz"))
        fresh = rows.where(of(day)).withColumn("updated_at", at)
        if name == "orders":  # pending at first, and settled two days later
            settled = rows.where(of(day - timedelta(days=2))).withColumn("updated_at", self.later(at, F.lit(2 * 86_400)))
            return fresh.withColumn("status", F.lit("pending")).unionByName(settled)
        if name == "support_tickets":
            done = F.col("resolved_at")
            closed = rows.where((done >= F.lit(day).cast("timestamp_ntz")) & (done < F.lit(day + timedelta(days=1)).cast("timestamp_ntz"))).withColumn("updated_at", done)
            none = {"status": F.lit("open"), "resolved_at": F.lit(None).cast("timestamp_ntz"), "satisfaction_score": F.lit(None).cast("int")}
            return fresh.withColumns(none).unionByName(closed)
        return fresh


# Faults.


@dataclass(frozen=True)
class Fault:
    fault_id: str
    kind: str
    table: str
    column: str | None = None
    value: str | None = None
    expected_check: str = ""


#: The nine faults and the check that should see each.
FAULTS = (
    Fault("F1", "null_spike", "orders", "customer_id", None, "not_null on stg_orders.customer_id"),
    Fault("F2", "invalid_category", "support_tickets", "priority", "p0", "accepted_values on stg_support_tickets.priority"),
    Fault("F3", "orphan_keys", "payments", "order_id", None, "relationships from stg_payments.order_id to stg_orders"),
    Fault("F4", "stale_source", "web_sessions", None, None, "source freshness on raw.web_sessions"),
    Fault("F5", "schema_drop", "marketing_spend", "clicks", None, "model error on stg_marketing_spend"),
    Fault("F6", "volume_drop", "orders", None, None, "row_count_in_range on stg_orders"),
    Fault("F7", "schema_rename", "marketing_campaigns", "channel", None, "model error on stg_marketing_campaigns"),
    Fault("F8", "invalid_category", "payments", "status", "chargeback", "accepted_values on stg_payments.payment_status"),
    Fault("F9", "loader_nulls", "web_sessions", "device", None, "column_profile on raw.web_sessions (device NULLs)"),
)


def planted(rows: DataFrame, fault: Fault, seed: int, one_in: int = 5) -> DataFrame:
    """A table as a fault leaves it; rows are hit by a hash of their key, so what was hit can be told again."""
    key = KEYS[fault.table]
    hit = tables.hashed(seed, key) % one_in == 0
    if fault.kind in ("null_spike", "loader_nulls"):
        return tables.updated(rows, hit, **{fault.column: F.lit(None)})
    if fault.kind == "invalid_category":
        return tables.updated(rows, hit, **{fault.column: F.lit(fault.value)})
    if fault.kind == "orphan_keys":
        return tables.updated(rows, hit, **{fault.column: -F.col(fault.column)})
    if fault.kind == "volume_drop":
        return tables.deleted(rows, tables.hashed(seed, key) % one_in != 0)
    if fault.kind == "stale_source":
        return rows.limit(0)  # nothing arrives
    if fault.kind == "schema_drop":
        return tables.dropped(rows, fault.column)
    return tables.renamed(rows, fault.column, f"{fault.column}_v2")


def truth(rows: DataFrame, fault: Fault, seed: int, one_in: int = 5) -> DataFrame:
    """key, column_name of the cells that a fault hit."""
    return rows.where(tables.hashed(seed, KEYS[fault.table]) % one_in == 0).select(F.col(KEYS[fault.table]).cast("string").alias("row_key"), F.lit(fault.column).alias("column_name"), F.lit(fault.fault_id).alias("label"))


# Workload.


def workload(spark: SparkSession, dashboards: Mapping[str, int], people: Sequence[str], templates: Sequence[str], day: datetime, days: int, seed: int, per_person: int = 3) -> DataFrame:
    """The queries people and dashboards send: sim, actor, subject, person, sql. A dashboard refreshes every so many hours
    from a time that a hash gives it, people ask some templates a day."""
    dates = spark.range(days).select(F.expr(f"timestamp_ntz'{day:%Y-%m-%d %H:%M:%S}' + make_dt_interval(CAST(id AS INT))").alias("day"))
    boards = spark.createDataFrame([(k, v) for k, v in dashboards.items()], "subject string, every int")
    first = 3 + F.pmod(stable_hash(F.lit(seed), F.lit("refresh"), F.col("subject")), F.least("every", F.lit(21)).cast("decimal(20,0)")).cast("int")
    hours = boards.select("subject", F.explode(F.filter(F.sequence(first, F.lit(23), F.col("every")), lambda h: h < 24)).alias("hour"))
    at = lambda h: F.col("day") + F.make_dt_interval(F.lit(0), h)
    refreshed = dates.join(F.broadcast(hours)).select(at(F.col("hour")).alias("sim"), F.lit("dashboard").alias("actor"), "subject", F.lit(None).cast("string").alias("person"), F.concat(F.lit("SELECT * FROM "), "subject").alias("sql"))
    asks = spark.createDataFrame([(p, n) for p in people for n in range(per_person)], "person string, nth int")
    pick = F.pmod(stable_hash(F.lit(seed), F.col("person"), F.date_format("day", "yyyy-MM-dd"), F.col("nth")), F.lit(len(templates)).cast("decimal(20,0)")).cast("int")
    sql = F.replace(F.get(F.array(*[F.lit(x) for x in templates]), pick), F.lit("{day}"), F.date_format("day", "yyyy-MM-dd"))
    asked = dates.join(F.broadcast(asks)).select(at(9 + F.col("nth")).alias("sim"), F.lit("adhoc").alias("actor"), F.lit(None).cast("string").alias("subject"), "person", sql.alias("sql"))
    return refreshed.unionByName(asked)


# Days in order.


@dataclass
class Company:
    """A shop's days: each freezes reports, copies what changed, compacts, builds, runs the workload and compares. The
    steps are given; their order and the clock are kept here."""

    start: datetime
    steps: Sequence[tuple[str, Callable[[datetime], object]]]

    def run(self, days: int, pause: Callable[[str, datetime], bool] = lambda step, day: False) -> list[tuple[datetime, str, object]]:
        """(day, step, what it gave) in order; ``pause`` may skip a step on a day (a copy job that stops, say)."""
        out = []
        for k in range(days):
            day = self.start + timedelta(days=k)
            out += [(day, name, step(day)) for name, step in self.steps if not pause(name, day)]
        return out
