"""The shop's raw tables, derived from the test tables.

Every raw column is one expression that Spark and DuckDB read alike (``{TS}`` is the engine's name of a timestamp
without zone), so the same text makes the raw rows for both sides of a comparison. Raw tables hold versions:
several rows of one key, of which the newest load counts (``latest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CENTS = "CAST(CAST(floor({0}) AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"
EPOCH = "CAST('1994-01-01 00:00:00' AS {TS})"
ORDER_TIME = "o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440)"
SHIFT = "ts - INTERVAL '1' DAY * 10600 + INTERVAL '1' DAY * ((event_id % 60) * 30)"

#: table: (key, [(test table, condition, {column: expression}), ...])
RAW: dict[str, tuple[str, list[tuple[str, str, dict[str, str]]]]] = {
    "customers": (
        "customer_id",
        [("customer", "TRUE", {
            "customer_id": "c_custkey",
            "first_name": "c_name",
            "last_name": "c_mktsegment",
            "email": "CASE WHEN c_custkey % 50 = 7 THEN concat('  USER', CAST(c_custkey - 1 AS VARCHAR(20)), '@Example.COM ') ELSE concat('user', CAST(c_custkey AS VARCHAR(20)), '@example.com') END",
            "phone": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('+1-', CAST(c_custkey AS VARCHAR(20))) END",
            "country": "concat('N', CAST(c_nationkey AS VARCHAR(20)))",
            "referral_source": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lower(c_mktsegment) END",
            "signed_up_at": f"{EPOCH} + INTERVAL '1' HOUR * ((c_custkey * 37) % 30000)",
            "_loaded_at": f"{EPOCH} + INTERVAL '1' HOUR * ((c_custkey * 37) % 30000 + 5)",
            "_seq": "1",
        })],
    ),
    "orders": (
        "order_id",
        [("orders", cond, {
            "order_id": "o_orderkey",
            "customer_id": "o_custkey",
            "ordered_at": ORDER_TIME,
            "status": status,
            "channel": "CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'web' WHEN substring(o_orderpriority, 1, 1) IN ('3', '4') THEN 'mobile' ELSE 'store' END",
            "discount_code": "CASE WHEN o_orderkey % 7 = 0 THEN concat('SAVE', CAST(o_orderkey % 3 AS VARCHAR(20))) ELSE NULL END",
            "currency": "'USD'",
            "_loaded_at": f"o_orderdate + INTERVAL '1' DAY * {days}",
            "_seq": seq,
        }) for cond, status, days, seq in (
            ("TRUE", "CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'shipped' WHEN o_orderkey % 12 = 0 THEN 'returned' WHEN o_orderkey % 12 = 1 THEN 'cancelled' ELSE 'completed' END", "2", "2"),
            ("o_orderkey % 5 = 0", "'pending'", "1", "1"),
        )],
    ),
    "order_items": (
        "order_item_id",
        [("lineitem", "TRUE", {
            "order_item_id": "l_orderkey * 8 + l_linenumber",
            "order_id": "l_orderkey",
            "line_number": "l_linenumber",
            "product_id": "l_partkey",
            "quantity": "CAST(l_quantity AS INT)",
            "unit_price": CENTS.format("round(l_extendedprice * 100) / l_quantity"),
            "_loaded_at": "l_shipdate",
            "_seq": "CAST(l_partkey * 1000000 + (l_suppkey % 10000) * 60 + CAST(l_quantity AS INT) AS BIGINT)",
        })],
    ),
    "products": (
        "product_id",
        [("part", "TRUE", {
            "product_id": "p_partkey",
            "product_name": "p_name",
            "category": "p_type",
            "unit_price": CENTS.format("round(p_retailprice * 100)"),
            "unit_cost": CENTS.format("round(p_retailprice * 100) * 6 / 10"),
            "is_active": "p_size % 5 <> 0",
            "created_at": f"{EPOCH} + INTERVAL '1' DAY * (p_partkey % 365)",
            "_loaded_at": f"{EPOCH} + INTERVAL '1' DAY * (p_partkey % 365 + 1)",
            "_seq": "1",
        })],
    ),
    "payments": (
        "payment_id",
        [("orders", "o_orderkey % 50 <> 3 AND o_orderstatus <> 'P'", {
            "payment_id": "o_orderkey",
            "order_id": "o_orderkey",
            "payment_method": "CASE WHEN o_orderkey % 3 = 0 THEN 'card' WHEN o_orderkey % 3 = 1 THEN 'paypal' ELSE 'bank' END",
            "status": "CASE WHEN o_orderkey % 24 = 0 THEN 'refunded' WHEN o_orderkey % 17 = 0 THEN 'failed' ELSE 'succeeded' END",
            "amount": CENTS.format("round(o_totalprice * 100)"),
            "created_at": f"{ORDER_TIME} + INTERVAL '1' HOUR",
            "_loaded_at": f"{ORDER_TIME} + INTERVAL '1' HOUR * (CASE WHEN o_orderkey % 9 = 0 THEN 73 ELSE 3 END)",
            "_seq": "1",
        })],
    ),
    "web_sessions": (
        "session_id",
        [("events", "TRUE", {
            "session_id": "event_id",
            "customer_id": "CASE WHEN event_id % 2 = 0 THEN user_id ELSE NULL END",
            "started_at": SHIFT,
            "device": "CASE WHEN event_id % 3 = 0 THEN 'desktop' WHEN event_id % 3 = 1 THEN 'phone' ELSE 'tablet' END",
            "landing_page": "concat('/p/', CAST(event_id % 5 AS VARCHAR(20)))",
            "utm_source": "CASE WHEN event_id % 10 = 0 THEN 'email' WHEN event_id % 10 = 2 THEN 'paid_search' WHEN event_id % 10 = 4 THEN 'social' WHEN event_id % 10 = 6 THEN 'display' ELSE NULL END",
            "campaign_id": "CASE WHEN event_id % 10 IN (0, 2, 4, 6) THEN event_id % 25 + 1 ELSE NULL END",
            "pageviews": "CAST(event_id % 9 + 1 AS INT)",
            "duration_seconds": "CAST((event_id * 37) % 1800 AS INT)",
            "converted": "event_type = 'purchase'",
            "_loaded_at": f"{SHIFT} + INTERVAL '1' HOUR",
            "_seq": "1",
        })],
    ),
    "marketing_campaigns": (
        "campaign_id",
        [("nation", "TRUE", {
            "campaign_id": "CAST(n_nationkey + 1 AS BIGINT)",
            "campaign_name": "n_name",
            "channel": "CASE WHEN n_regionkey = 0 THEN 'email' WHEN n_regionkey = 1 THEN 'social' WHEN n_regionkey = 2 THEN 'display' WHEN n_regionkey = 3 THEN 'paid_search' ELSE 'affiliate' END",
            "start_date": f"CAST({EPOCH} + INTERVAL '1' DAY * (n_nationkey * 40) AS DATE)",
            "end_date": f"CAST({EPOCH} + INTERVAL '1' DAY * (n_nationkey * 40 + 60 + n_nationkey) AS DATE)",
            "budget": "CAST(1000 + n_nationkey * 250 AS DECIMAL(12,2))",
            "_loaded_at": EPOCH,
            "_seq": "1",
        })],
    ),
    "marketing_spend": (
        "spend_id",
        [("orders", "o_orderkey % 3 = 0", {
            "spend_id": "o_orderkey",
            "campaign_id": "CAST(o_orderkey % 25 + 1 AS BIGINT)",
            "spend_date": "CAST(o_orderdate AS DATE)",
            "spend": CENTS.format("(o_orderkey * 7919) % 50000"),
            "impressions": "CAST((o_orderkey * 13) % 5000 + 1 AS BIGINT)",
            "clicks": "CAST((o_orderkey * 13) % 97 AS BIGINT)",
            "_loaded_at": "o_orderdate + INTERVAL '1' DAY",
            "_seq": "1",
        })],
    ),
    "support_tickets": (
        "ticket_id",
        [("events", "event_type = 'error'", {
            "ticket_id": "event_id",
            "customer_id": "user_id",
            "order_id": "CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 1500 END",
            "category": "concat('topic', CAST(event_id % 5 AS VARCHAR(20)))",
            "priority": "CASE WHEN event_id % 7 = 0 THEN 'urgent' WHEN event_id % 7 < 3 THEN 'high' WHEN event_id % 7 < 5 THEN 'normal' ELSE 'low' END",
            "status": "CASE WHEN event_id % 6 = 0 THEN 'open' WHEN event_id % 6 = 1 THEN 'pending' ELSE 'closed' END",
            "created_at": SHIFT,
            "resolved_at": f"CASE WHEN event_id % 6 > 1 THEN {SHIFT} + INTERVAL '1' MINUTE * ((event_id * 31) % 9000) ELSE NULL END",
            "satisfaction_score": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS INT) END",
            "_loaded_at": f"{SHIFT} + INTERVAL '2' HOUR",
            "_seq": "1",
        })],
    ),
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All versions of a raw table."""
    out = None
    for source, condition, columns in RAW[name][1]:
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(condition)
        rows = rows.selectExpr(*[f"{e.replace('{TS}', 'TIMESTAMP_NTZ')} AS {c}" for c, e in columns.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def raw_sql(name: str) -> str:
    """The same rows in DuckDB's SQL."""
    return " UNION ALL ".join(
        f"SELECT {', '.join(f'{e.replace("{TS}", "TIMESTAMP")} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition}"
        for source, condition, columns in RAW[name][1]
    )


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest version of each key: by load time, then by the order of arrival."""
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order or ("_loaded_at", "_seq")])
    return rows.withColumn("_version", F.row_number().over(newest)).where("_version = 1").drop("_version", "_seq")


def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed table: country, country_name, region."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country"),
        F.col("n_name").alias("country_name"),
        F.col("r_name").alias("region"),
    )


COUNTRY_SQL = "SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS country, n_name AS country_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"
