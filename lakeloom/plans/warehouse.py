"""The shop's models as DataFrame plans.

``Warehouse(spark, sf_dir)`` gives any model by name; models name the models they read, so that asking for one
builds the plan of all it needs and Catalyst optimizes it as a whole. Money stays decimal throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.money import avg_half_up, boundaries, period, ratio
from lakeloom.operators import timeline
from lakeloom.sources.company import RAW, country_codes, latest, raw

MODELS: dict[str, Callable[[Warehouse], DataFrame]] = {}
SOLD = ("completed", "shipped")
#: Versions of rows that one task sorts, where a table makes this many parts of them at least: what joins it is dealt
#: out like it, and a smaller table must not hold a larger one together.
TASK_ROWS, LEAST_PARTS = 500_000, 32


class Warehouse:
    """Plans of the models over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._plans: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = MODELS[name](self)
        return self._plans[name]

    def current(self, name: str) -> DataFrame:
        """A raw table's newest versions. Those of a large table are dealt out by a counted number, which stands however
        well the rows compress, so the sort in a task doesn't grow with the table, nor is there one before the shuffle."""
        rows, key = raw(self.spark, self.sf_dir, name), RAW[name][0]
        n = -(-rows.count() // TASK_ROWS)
        return latest(rows.repartition(n, key) if n >= LEAST_PARTS else rows, key)

    def priced(self) -> DataFrame:
        """Orders with their amounts, for models that ask for nobody behind them."""
        return priced_orders(self)

    @cached_property
    def countries(self) -> DataFrame:
        return country_codes(self.spark, self.sf_dir)


def model(f: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    MODELS[f.__name__] = f
    return f


def zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def where_sum(condition: Column, c: str) -> Column:
    return F.sum(F.when(condition, F.col(c)))


# Staging: newest versions, named and typed.


@model
def stg_customers(w):
    return w.current("customers").withColumns(
        {"email_raw": F.col("email"), "email": F.lower(F.trim("email")), "referral_source": F.coalesce("referral_source", F.lit("unknown"))}
    )


@model
def stg_orders(w):
    return w.current("orders").withColumns({"order_date": F.to_date("ordered_at"), "has_discount": F.col("discount_code").isNotNull()})


@model
def stg_order_items(w):
    return w.current("order_items").withColumn("line_amount", F.col("quantity") * F.col("unit_price"))


@model
def stg_payments(w):
    late = F.col("_loaded_at") > F.col("created_at") + F.expr("INTERVAL '1' DAY")
    return w.current("payments").withColumn("is_late_arriving", late).withColumnsRenamed({"status": "payment_status", "created_at": "paid_at"})


@model
def stg_products(w):
    return w.current("products")


@model
def stg_web_sessions(w):
    return w.current("web_sessions").withColumns(
        {"session_date": F.to_date("started_at"), "traffic_source": F.coalesce("utm_source", F.lit("direct"))}
    ).drop("utm_source")


@model
def stg_support_tickets(w):
    return w.current("support_tickets").withColumnRenamed("status", "ticket_status")


@model
def stg_marketing_campaigns(w):
    return w.current("marketing_campaigns").withColumn("planned_days", F.datediff("end_date", "start_date").cast("long"))


@model
def stg_marketing_spend(w):
    return w.current("marketing_spend")


# Intermediate.


@model
def int_customer_id_map(w):
    first = W.partitionBy("email").orderBy("signed_up_at", "customer_id")
    return w("stg_customers").select("customer_id", F.first("customer_id").over(first).alias("canonical_customer_id"))


@model
def int_customers_deduplicated(w):
    extra = w("int_customer_id_map").groupBy(F.col("canonical_customer_id").alias("customer_id")).agg((F.count(F.lit(1)) - 1).alias("duplicate_accounts"))
    keep = ["customer_id", "first_name", "last_name", "email", "phone", "country", "referral_source", "signed_up_at"]
    return w("stg_customers").select(*keep).join(extra, "customer_id")


@model
def int_order_items_enriched(w):
    orders = w("stg_orders").select("order_id", "ordered_at", F.col("status").alias("order_status"))
    products = w("stg_products").select("product_id", "product_name", "category", "unit_cost")
    cost = F.col("quantity") * F.col("unit_cost")
    rows = w("stg_order_items").join(orders, "order_id").join(products, "product_id")
    return rows.withColumns({"line_cost": cost, "line_margin": F.col("line_amount") - cost}).drop("unit_cost", "_loaded_at")


@model
def int_order_totals(w):
    return w("int_order_items_enriched").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_lines"),
        F.sum("quantity").alias("units"),
        F.sum("line_amount").alias("gross_amount"),
        F.sum("line_cost").alias("cost_amount"),
        F.sum("line_margin").alias("line_margin_amount"),
    )


def priced_orders(w):
    """Orders with their amounts, without the people behind them: two joins on the order less."""
    totals = w("int_order_totals").drop("line_margin_amount")
    off = F.when(F.col("has_discount"), F.round(F.col("gross_amount") * F.lit("0.10").cast("decimal(4,2)"), 2)).otherwise(F.lit(0))
    rows = w("stg_orders").drop("currency", "_loaded_at").join(totals, "order_id").withColumn("discount_amount", off.cast("decimal(18,2)"))
    net = F.col("gross_amount") - F.col("discount_amount")
    return rows.withColumns({"net_amount": net, "margin_amount": net - F.col("cost_amount")})


@model
def int_orders_enriched(w):
    homes = w("stg_customers").select(F.col("customer_id").alias("canonical_customer_id"), "country")
    return priced_orders(w).join(w("int_customer_id_map"), "customer_id", "left").join(homes, "canonical_customer_id", "left")


@model
def int_payments_by_order(w):
    status = F.col("payment_status")
    return w("stg_payments").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_count"),
        where_sum(status == "succeeded", "amount").alias("paid_amount"),
        where_sum(status == "refunded", "amount").alias("refunded_amount"),
        F.min("paid_at").alias("first_paid_at"),
        F.max("paid_at").alias("last_paid_at"),
        F.bool_or("is_late_arriving").alias("has_late_payment"),
    )


@model
def int_order_payment_status(w):
    orders = w.priced().select("order_id", "ordered_at", "order_date", F.col("status").alias("order_status"), "channel", "gross_amount", "net_amount")
    rows = orders.join(w("int_payments_by_order"), "order_id", "left")
    verdict = (
        F.when(F.col("order_status").isin("pending", "cancelled"), "not_due")
        .when((F.col("order_status") == "returned") & F.col("refunded_amount").isNotNull(), "refunded")
        .when(F.col("payment_count").isNull(), "missing")
        .when(zero("paid_amount") >= F.col("gross_amount") - F.lit("0.01").cast("decimal(4,2)"), "paid")
        .otherwise("underpaid")
    )
    rows = rows.withColumn("payment_status", verdict)
    return rows.withColumns({
        "paid_amount": zero("paid_amount"), "refunded_amount": zero("refunded_amount"), "payment_count": zero("payment_count"),
        "has_late_payment": F.coalesce("has_late_payment", F.lit(False)),
    })


@model
def int_customer_orders(w):
    placed = w("int_orders_enriched").where((F.col("status") != "cancelled") & F.col("canonical_customer_id").isNotNull())
    return placed.groupBy("canonical_customer_id").agg(
        F.min("ordered_at").alias("first_order_at"),
        F.max("ordered_at").alias("last_order_at"),
        F.count(F.lit(1)).alias("order_count"),
        where_sum(F.col("status").isin(*SOLD), "net_amount").alias("lifetime_revenue"),
    )


@model
def int_customer_segments(w):
    people = w("int_customer_orders")
    as_of = F.broadcast(people.agg(F.max("last_order_at").alias("as_of")))  # one row
    value = zero("lifetime_revenue")
    segment = F.when(value >= 2000, "vip").when(value >= 500, "regular").otherwise("occasional")
    return people.crossJoin(as_of).select(
        "canonical_customer_id", value.alias("lifetime_revenue"), "order_count", segment.alias("value_segment"),
        (F.col("last_order_at") < F.col("as_of") - F.expr("INTERVAL '90' DAY")).alias("is_lapsed"),
    )


@model
def int_sessions_enriched(w):
    campaigns = w("stg_marketing_campaigns").select("campaign_id", "campaign_name", F.col("channel").alias("campaign_channel"))
    rows = w("stg_web_sessions").join(w("int_customer_id_map"), "customer_id", "left").join(campaigns, "campaign_id", "left")
    return rows.withColumn("is_known_visitor", F.col("customer_id").isNotNull()).drop("_loaded_at")


@model
def int_sessions_daily(w):
    return w("int_sessions_enriched").groupBy("session_date", "device", "traffic_source").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("is_known_visitor").alias("known_visitor_sessions"),
        F.count_if(F.col("pageviews") >= 3).alias("engaged_sessions"),
        F.count_if("converted").alias("converted_sessions"),
        F.sum("pageviews").alias("pageviews"),
        F.sum("duration_seconds").alias("duration_seconds"),
    )


TOUCH = ("touch_at", "touch_session_id", "campaign_id", "attributed_channel")


def sold_orders(w):
    return w("int_orders_enriched").where(F.col("status").isin(*SOLD)).select("order_id", "ordered_at", "net_amount", "canonical_customer_id")


def touches(w):
    """Campaign sessions of known people."""
    return w("int_sessions_enriched").where(F.col("campaign_id").isNotNull() & F.col("canonical_customer_id").isNotNull()).select(
        F.col("session_id").alias("touch_session_id"), "campaign_id", F.col("campaign_channel").alias("attributed_channel"),
        F.col("started_at").alias("touch_at"), "canonical_customer_id",
    )


def last_touch(w, days: int):
    """The last touch of each order within some days: orders and sessions of a person on one time line, on which the
    newest session is carried forward. Linear in a person's rows, where a join would pair them all, and a person with
    many of them is spread over time ranges."""
    touch = F.struct(*TOUCH).alias("_t")
    marks = touches(w).select("canonical_customer_id", F.col("touch_at").alias("_at"), F.lit(False).alias("_asks"), F.col("touch_session_id").alias("_id"), touch, F.lit(None).alias("_o"))
    asks = sold_orders(w).select("canonical_customer_id", F.col("ordered_at").alias("_at"), F.lit(True).alias("_asks"), F.col("order_id").alias("_id"), F.lit(None).alias("_t"), F.struct("order_id", "ordered_at", "net_amount").alias("_o"))
    seen = timeline.carried(marks.unionByName(asks), ["canonical_customer_id"], ["_at", "_asks", "_id"], "_t", "_last").where("_asks")
    return seen.where(F.col("_last.touch_at") > F.col("_at") - F.expr(f"INTERVAL '{days}' DAY")).select("_o.*", "_last.*")


def first_touch(w):
    """The first touch of each order: it is the person's first of all, if that is early enough."""
    first = touches(w).groupBy("canonical_customer_id").agg(F.min(F.struct(*TOUCH)).alias("_t"))
    return sold_orders(w).join(first, "canonical_customer_id").where(F.col("_t.touch_at") <= F.col("ordered_at")).select("order_id", "ordered_at", "net_amount", "_t.*")


@model
def int_campaign_attribution(w):
    return last_touch(w, 7)


@model
def int_campaign_performance_daily(w):
    spend = w("stg_marketing_spend").groupBy("campaign_id", F.col("spend_date").alias("activity_date")).agg(
        F.sum("spend").alias("spend"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )
    sessions = w("int_sessions_enriched").where(F.col("campaign_id").isNotNull()).groupBy("campaign_id", F.col("session_date").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("sessions")
    )
    orders = w("int_campaign_attribution").groupBy("campaign_id", F.to_date("ordered_at").alias("activity_date")).agg(
        F.count(F.lit(1)).alias("attributed_orders"), F.sum("net_amount").alias("attributed_revenue")
    )
    # One union and one aggregate on the key stand for the distinct keys and three joins to them.
    every = spend.unionByName(sessions, allowMissingColumns=True).unionByName(orders, allowMissingColumns=True)
    measures = ["spend", "impressions", "clicks", "sessions", "attributed_orders", "attributed_revenue"]
    days = every.groupBy("campaign_id", "activity_date").agg(*[zero(F.sum(m)).alias(m) for m in measures])
    return days.join(w("stg_marketing_campaigns").select("campaign_id", "campaign_name", "channel"), "campaign_id")


@model
def int_product_sales_daily(w):
    sold = w("int_order_items_enriched").where(F.col("order_status").isin(*SOLD))
    return sold.groupBy("product_id", "category", F.to_date("ordered_at").alias("sale_date")).agg(
        F.sum("quantity").alias("units"), F.sum("line_amount").alias("revenue"), F.sum("line_margin").alias("margin")
    )


@model
def int_tickets_enriched(w):
    orders = w("stg_orders").select("order_id", F.col("channel").alias("order_channel"))
    minutes = boundaries("minute", "created_at", "resolved_at")
    hours = F.round(minutes.cast("decimal(18,0)") / F.lit(60).cast("decimal(4,0)"), 2).cast("decimal(12,2)")
    return w("stg_support_tickets").join(w("int_customer_id_map"), "customer_id", "left").join(orders, "order_id", "left").withColumn("resolution_hours", hours)


@model
def int_ticket_resolution(w):
    target = F.expr("CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 24 WHEN 'normal' THEN 72 ELSE 168 END")
    rows = w("int_tickets_enriched").withColumn("sla_hours", target)
    return rows.withColumn("breached_sla", F.when(F.col("resolution_hours").isNotNull(), F.col("resolution_hours") > F.col("sla_hours")))


# Marts.


@model
def sales_fct_orders(w):
    return w("int_orders_enriched").drop("customer_id").withColumnRenamed("canonical_customer_id", "customer_id")


@model
def sales_fct_order_items(w):
    return w("int_order_items_enriched")


@model
def sales_fct_daily_sales(w):
    return w("sales_fct_orders").groupBy("order_date").agg(
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        where_sum(F.col("status").isin(*SOLD), "net_amount").alias("net_revenue"),
        avg_half_up("net_amount").alias("avg_order_value"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_orders"),
    )


@model
def sales_channel_performance(w):
    return w.priced().groupBy(period("monthly", "ordered_at").alias("order_month"), "channel").agg(
        F.count(F.lit(1)).alias("orders"),
        where_sum(F.col("status").isin(*SOLD), "net_amount").alias("net_revenue"),
        avg_half_up("net_amount").alias("avg_order_value"),
        ratio(F.count_if("has_discount"), F.count(F.lit(1))).alias("discount_share"),
        ratio(F.count_if(F.col("status") == "returned"), F.count(F.lit(1))).alias("return_rate"),
    )


@model
def sales_dim_customers(w):
    orders = w("int_customer_orders").select(F.col("canonical_customer_id").alias("customer_id"), "first_order_at", "last_order_at", "order_count")
    segments = w("int_customer_segments").select(F.col("canonical_customer_id").alias("customer_id"), "lifetime_revenue", "value_segment", "is_lapsed")
    rows = w("int_customers_deduplicated").drop("phone").join(orders, "customer_id", "left").join(segments, "customer_id", "left").join(w.countries, "country", "left")
    return rows.withColumns({
        "order_count": zero("order_count"), "lifetime_revenue": zero("lifetime_revenue"),
        "value_segment": F.coalesce("value_segment", F.lit("prospect")), "is_lapsed": F.coalesce("is_lapsed", F.lit(False)),
    })


@model
def sales_customer_cohorts(w):
    cohorts = w("sales_dim_customers").select("customer_id", period("monthly", "signed_up_at").alias("cohort_month"))
    active = w("sales_fct_orders").where(F.col("status") != "cancelled").select("customer_id", period("monthly", "ordered_at").alias("_month")).distinct()
    rows = cohorts.join(active, "customer_id").where(F.col("_month") >= F.col("cohort_month"))
    return rows.groupBy("cohort_month", boundaries("month", "cohort_month", "_month").alias("months_since_signup")).agg(F.count(F.lit(1)).alias("active_customers"))


@model
def marketing_dim_campaigns(w):
    return w("stg_marketing_campaigns").drop("_loaded_at")


@model
def marketing_fct_attributed_orders(w):
    names = w("marketing_dim_campaigns").select("campaign_id", "campaign_name")
    rows = w("int_campaign_attribution").join(names, "campaign_id").drop("touch_session_id")
    return rows.withColumn("hours_from_touch", boundaries("hour", "touch_at", "ordered_at"))


@model
def marketing_fct_daily_spend(w):
    measures = ["spend", "impressions", "clicks", "sessions", "attributed_orders", "attributed_revenue"]
    return w("int_campaign_performance_daily").groupBy("activity_date", "channel").agg(*[F.sum(m).alias(m) for m in measures])


@model
def marketing_fct_campaign_performance(w):
    measures = ["spend", "impressions", "clicks", "sessions", "attributed_orders", "attributed_revenue"]
    totals = w("int_campaign_performance_daily").groupBy("campaign_id").agg(*[F.sum(m).alias(m) for m in measures])
    back = F.when(F.col("attributed_orders") > 0, ratio("attributed_revenue", "spend"))
    rows = w("marketing_dim_campaigns").drop("planned_days").join(totals, "campaign_id", "left").withColumn("return_on_ad_spend", back)
    return rows.withColumns({m: zero(m) for m in measures})


@model
def marketing_fct_sessions(w):
    return w("int_sessions_enriched")


@model
def marketing_acquisition_funnel(w):
    people = w("int_customers_deduplicated")
    key = ["month", "referral_source"]
    signups = people.groupBy(period("monthly", "signed_up_at").alias("month"), "referral_source").agg(F.count(F.lit(1)).alias("signups"))
    first = w("int_customer_orders").select(F.col("canonical_customer_id").alias("customer_id"), period("monthly", "first_order_at").alias("month"))
    buyers = first.join(people.select("customer_id", "referral_source"), "customer_id").groupBy(*key).agg(F.count(F.lit(1)).alias("first_orders"))
    return signups.join(buyers, key, "full").withColumns({"signups": zero("signups"), "first_orders": zero("first_orders")})


@model
def finance_fct_gross_margin(w):
    return w("int_orders_enriched").where(F.col("status").isin(*SOLD)).withColumn("margin_pct", ratio("margin_amount", "net_amount"))


@model
def finance_fct_marketing_spend(w):
    return w("int_campaign_performance_daily").groupBy(period("monthly", "activity_date").alias("spend_month"), "channel").agg(
        F.sum("spend").alias("spend"), F.sum("attributed_revenue").alias("attributed_revenue")
    )


@model
def finance_fct_payments_reconciliation(w):
    owed = F.when(F.col("payment_status").isin("missing", "underpaid"), F.col("gross_amount") - F.col("paid_amount")).otherwise(F.lit(0))
    return w("int_order_payment_status").withColumn("outstanding_amount", owed)


@model
def finance_fct_refunds(w):
    return w("int_order_payment_status").where(F.col("order_status") == "returned").withColumn("refund_missing", F.col("payment_status") == "missing")


def recognized(orders):
    returned, net = F.col("status") == "returned", F.col("net_amount")
    rows = orders.where(F.col("status").isin(*SOLD, "returned")).withColumnRenamed("ordered_at", "recognized_at")
    return rows.withColumns({"recognized_revenue": F.when(~returned, net).otherwise(F.lit(0)), "returned_revenue": F.when(returned, net).otherwise(F.lit(0))})


@model
def finance_fct_revenue(w):
    return recognized(w("int_orders_enriched"))


@model
def finance_fct_revenue_monthly(w):
    return recognized(w.priced()).groupBy(period("monthly", "recognized_at").alias("revenue_month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross_revenue"), F.sum("discount_amount").alias("discounts"),
        F.sum("recognized_revenue").alias("recognized_revenue"), F.sum("returned_revenue").alias("returned_revenue"),
    )


@model
def product_dim_products(w):
    """Sales are summed by product before any product is joined: neither the sold items nor a row for each product and
    day are then sorted or held by product."""
    orders = w("stg_orders").where(F.col("status").isin(*SOLD)).select("order_id", F.to_date("ordered_at").alias("sale_date"))
    revenue = w("int_product_sales_daily").agg(F.sum("revenue")).schema[0].dataType
    sales = w("stg_order_items").join(orders, "order_id").groupBy("product_id").agg(
        F.min("sale_date").alias("first_sold_date"), F.max("sale_date").alias("last_sold_date"),
        F.sum("quantity").alias("lifetime_units"), F.sum("line_amount").cast(revenue).alias("lifetime_revenue"),
    )
    rows = w("stg_products").join(sales, "product_id", "left")
    return rows.withColumns({"lifetime_units": zero("lifetime_units"), "lifetime_revenue": zero("lifetime_revenue")})


@model
def product_fct_product_sales_daily(w):
    return w("int_product_sales_daily")


@model
def product_fct_conversion_funnel(w):
    return w("int_sessions_enriched").groupBy(F.col("session_date").alias("activity_date"), "device").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("is_known_visitor").alias("known_visitor_sessions"),
        F.count_if(F.col("pageviews") >= 3).alias("engaged_sessions"),
        F.count_if("converted").alias("converted_sessions"),
        ratio(F.count_if("converted"), F.count(F.lit(1))).alias("conversion_rate"),
    )


@model
def product_fct_sessions_engagement(w):
    measures = ["sessions", "engaged_sessions", "converted_sessions", "pageviews"]
    return w("int_sessions_daily").groupBy("session_date", "device").agg(
        *[F.sum(m).alias(m) for m in measures], ratio(F.sum("duration_seconds"), F.sum("sessions"), 2).alias("avg_duration_seconds")
    )


@model
def product_fct_support_tickets(w):
    return w("int_ticket_resolution")


@model
def product_fct_ticket_sla(w):
    return w("product_fct_support_tickets").groupBy(period("monthly", "created_at").alias("ticket_month"), "category", "priority").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count("resolution_hours").alias("resolved_tickets"),
        F.count_if("breached_sla").alias("breached_tickets"),
        avg_half_up("resolution_hours").alias("avg_resolution_hours"),
        avg_half_up("satisfaction_score").alias("avg_satisfaction"),
    )


# Retired models that users may still query.


@model
def finance_fct_revenue_v0(w):
    return w("int_orders_enriched").where(F.col("status").isin(*SOLD, "returned")).withColumn("revenue", F.col("net_amount"))


@model
def finance_rpt_payment_methods_2025(w):
    return w("stg_payments").groupBy("payment_method").agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"))


@model
def finance_rpt_q3_close_reconciliation(w):
    t = F.col("ordered_at")
    quarter = (t >= F.lit("1997-07-01").cast("timestamp_ntz")) & (t < F.lit("1997-10-01").cast("timestamp_ntz"))
    return w("int_order_payment_status").where(quarter).groupBy("order_status", "payment_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").alias("gross_amount"), F.sum("paid_amount").alias("paid_amount")
    )


@model
def marketing_fct_campaign_attribution_v1(w):
    return first_touch(w).groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("first_touch_orders"), F.sum("net_amount").alias("first_touch_revenue")
    )


@model
def marketing_fct_email_campaign_roi(w):
    email = w("stg_marketing_campaigns").where(F.col("channel") == "email").select("campaign_id", "campaign_name")
    return email.join(w("stg_marketing_spend"), "campaign_id").groupBy("campaign_id", "campaign_name").agg(
        F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"), ratio(F.sum("clicks"), F.sum("impressions")).alias("click_through_rate")
    )


@model
def marketing_rpt_utm_sources_legacy(w):
    source = F.col("traffic_source")
    group = F.when(source.isin("paid_search", "display", "social", "affiliate"), "paid").when(source == "email", "crm").otherwise("other")
    return w("stg_web_sessions").groupBy("session_date", group.alias("legacy_source_group")).agg(F.count(F.lit(1)).alias("sessions"))


@model
def product_fct_sessions_v1(w):
    return w("stg_web_sessions")


@model
def product_ml_features_churn_poc(w):
    tickets = w("int_tickets_enriched").groupBy("canonical_customer_id").agg(F.count("ticket_id").alias("support_tickets"))
    people = w("int_customer_segments").drop("value_segment").join(tickets, "canonical_customer_id", "left")
    return people.withColumn("support_tickets", zero("support_tickets")).withColumnRenamed("canonical_customer_id", "customer_id")


@model
def product_rpt_ticket_backlog_experiment(w):
    return w("stg_support_tickets").where(F.col("ticket_status").isin("open", "pending")).groupBy("category", "priority").agg(F.count(F.lit(1)).alias("open_tickets"))


@model
def sales_dim_customers_old_crm(w):
    return w("stg_customers").drop("email").withColumnRenamed("email_raw", "email")


@model
def sales_fct_orders_backfill_2025q1(w):
    t = F.col("ordered_at")
    return w("int_orders_enriched").where((t >= F.lit("1997-01-01").cast("timestamp_ntz")) & (t < F.lit("1997-04-01").cast("timestamp_ntz")))


@model
def sales_rpt_weekly_orders_legacy(w):
    return w("int_orders_enriched").where(F.col("status") != "cancelled").groupBy(period("weekly", "ordered_at").alias("order_week")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("net_amount").alias("net_revenue")
    )


# Rollups: one function for every family, grain and dimension.

GRAINS = ("daily", "weekly", "monthly")
#: family: (source, time column, dimensions, grains, measures as (name, how, column or None))
ROLLUPS = {
    "sales_rpt_orders": ("sales_fct_orders", "ordered_at", ("channel", "country", "status", "discount_code"), GRAINS,
                         (("orders", "count", None), ("customers", "distinct", "customer_id"), ("net_revenue", "sum", "net_amount"), ("avg_order_value", "mean", "net_amount"))),
    "sales_rpt_items": ("sales_fct_order_items", "ordered_at", ("category",), GRAINS[1:],
                        (("units", "sum", "quantity"), ("revenue", "sum", "line_amount"), ("margin", "sum", "line_margin"))),
    "marketing_rpt_sessions": ("marketing_fct_sessions", "started_at", ("device", "traffic_source", "landing_page"), GRAINS,
                               (("sessions", "count", None), ("converted_sessions", "count_if", "converted"), ("pageviews", "sum", "pageviews"))),
    "marketing_rpt_attributed_orders": ("marketing_fct_attributed_orders", "ordered_at", ("attributed_channel",), GRAINS,
                                        (("attributed_orders", "count", None), ("attributed_revenue", "sum", "net_amount"))),
    "marketing_rpt_spend": ("marketing_fct_daily_spend", "activity_date", ("channel",), GRAINS[1:],
                            (("spend", "sum", "spend"), ("impressions", "sum", "impressions"), ("clicks", "sum", "clicks"))),
    "finance_rpt_revenue": ("finance_fct_revenue", "recognized_at", ("channel", "country", "status"), GRAINS,
                            (("orders", "count", None), ("recognized_revenue", "sum", "recognized_revenue"), ("returned_revenue", "sum", "returned_revenue"))),
    "finance_rpt_margin": ("finance_fct_gross_margin", "ordered_at", ("channel", "country"), GRAINS[1:],
                           (("net_revenue", "sum", "net_amount"), ("cost", "sum", "cost_amount"), ("margin", "sum", "margin_amount"))),
    "finance_rpt_refunds": ("finance_fct_refunds", "ordered_at", ("channel",), GRAINS[2:],
                            (("refunds", "count", None), ("refunded_amount", "sum", "refunded_amount"))),
    "product_rpt_tickets": ("product_fct_support_tickets", "created_at", ("category", "priority", "ticket_status"), GRAINS,
                            (("tickets", "count", None), ("breached_tickets", "count_if", "breached_sla"), ("avg_resolution_hours", "mean", "resolution_hours"))),
    "product_rpt_product_sales": ("product_fct_product_sales_daily", "sale_date", ("category",), GRAINS[1:], (("units", "sum", "units"), ("revenue", "sum", "revenue"))),
    "product_rpt_engagement": ("product_fct_sessions_engagement", "session_date", ("device",), GRAINS[1:],
                               (("sessions", "sum", "sessions"), ("converted_sessions", "sum", "converted_sessions"))),
    "product_rpt_funnel": ("product_fct_conversion_funnel", "activity_date", ("device",), GRAINS[1:],
                           (("sessions", "sum", "sessions"), ("engaged_sessions", "sum", "engaged_sessions"), ("converted_sessions", "sum", "converted_sessions"))),
}


def rollup(rows: DataFrame, time: str, grain: str, dimension: str, measures: tuple) -> DataFrame:
    """Measures per period and value of one dimension; partial sums make any number of rows cheap to shuffle."""
    make = {
        "count": lambda c: F.count(F.lit(1)), "distinct": F.countDistinct, "sum": F.sum, "mean": avg_half_up, "count_if": F.count_if,
    }
    return rows.groupBy(period(grain, time).alias("period_start"), dimension).agg(*[make[how](c).alias(name) for name, how, c in measures])


def _register() -> None:
    for family, (source, time, dimensions, grains, measures) in ROLLUPS.items():
        for grain in grains:
            for dimension in dimensions:
                MODELS[f"{family}_{grain}_by_{dimension}"] = lambda w, s=source, t=time, g=grain, d=dimension, m=measures: rollup(w(s), t, g, d, m)


_register()
