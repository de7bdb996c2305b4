"""Queries of the parts that matter most on large tables: database reads by counted ranges, stored hash trees, snapshots
that outlive replacement, bucketed tables, late rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import faults, hash_tree, reconcile
from lakeloom.operators.faults import OneOff
from lakeloom.operators.reconcile import Rule
from lakeloom.plans.toolkit import tool
from lakeloom.session import shared_dir
from lakeloom.sources import bucketed, database
from lakeloom.sources.versioned import Versions
from lakeloom.streaming.late import daily_with_late


@tool("o_orderkey:l o_custkey:l o_totalprice:d o_orderdate:z", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'")
def scan_jdbc_range(t):
    """The orders in a database, read back by key ranges that it counted for the rows of the time range."""
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderdate")
    db = database.published(orders, "orders")
    return database.changed_rows(db, orders.sparkSession, "orders", "o_orderkey", "o_orderdate", "1995-01-01 00:00:00", "1996-06-30 00:00:00")


# A hash tree that follows a night's changes.

NIGHT = (
    "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice + CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS o_totalprice FROM orders WHERE o_orderkey % 91 <> 5 "
    "UNION ALL SELECT -o_orderkey - 1, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) FROM orders WHERE o_orderkey % 211 = 8"
)
NIGHT_TEXT = "concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR))"


def two_nights(t) -> tuple[hash_tree.Tree, hash_tree.Tree]:
    rules = {"o_orderkey": Rule("int"), "o_orderstatus": Rule("text"), "o_totalprice": Rule("decimal")}
    orders = t("orders").selectExpr("o_orderkey", "o_orderstatus", "CAST(o_totalprice AS DECIMAL(12,2)) o_totalprice")
    first = hash_tree.build(orders, ["o_orderkey"], rules, f"{shared_dir(orders.sparkSession)}/tree-{uuid.uuid4().hex}", parts_depth=1)
    dearer = orders.where("o_orderkey % 50 = 7 AND o_orderkey % 91 <> 5").withColumn("o_totalprice", (F.col("o_totalprice") + 1).cast("decimal(12,2)"))
    added = orders.where("o_orderkey % 211 = 8").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    gone = orders.where("o_orderkey % 91 = 5").select("o_orderkey")
    return first, hash_tree.advance(first, dearer.unionAll(added), gone, ["o_orderkey"], rules)


@tool("row_key:s kind:s", "SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN o_orderkey % 91 = 5 THEN 'missing' ELSE 'changed' END AS kind FROM orders WHERE o_orderkey % 91 = 5 OR o_orderkey % 50 = 7 UNION ALL SELECT CAST(-o_orderkey - 1 AS VARCHAR), 'extra' FROM orders WHERE o_orderkey % 211 = 8")
def hash_tree_differences(t):
    return hash_tree.differing(*two_nights(t))


HALF = "CAST(concat('0x', substr(md5({0}), {1}, 8)) AS BIGINT)"


@tool("level:l segment:l n_rows:l h1:l h2:l", f"SELECT level, b >> (32 - 4 * level) AS segment, count(*) AS n_rows, CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h2) AS BIGINT) AS h2 FROM (SELECT {HALF.format('CAST(o_orderkey AS VARCHAR)', 1)} AS b, {HALF.format(NIGHT_TEXT, 1)} AS h1, {HALF.format(NIGHT_TEXT, 9)} AS h2 FROM ({NIGHT})), range(0, 3) r(level) GROUP BY ALL")
def hash_tree_sums(t):
    """The upper levels after a night that hashed its changes only."""
    return two_nights(t)[1].levels().where("level <= 2")


# Versions of tables, and tables in buckets.


@tool("reader:s n_rows:l top:l", "SELECT 'opened before' AS reader, count(*) AS n_rows, max(o_orderkey) AS top FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'opened after', count(*), max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'customers of both', count(*), max(c_custkey) FROM customer")
def table_versions(t):
    """A reader that opened a version reads it on while its table is replaced, appended to, compacted."""
    orders, people = t("orders").select("o_orderkey", "o_orderstatus"), t("customer").select("c_custkey")
    versions = Versions(orders.sparkSession, f"{shared_dir(orders.sparkSession)}/versions-{uuid.uuid4().hex}")
    first = versions.commit(replace={"orders": orders.where("o_orderkey % 2 = 0"), "people": people})
    versions.commit(replace={"orders": orders.where("o_orderkey % 4 = 1")})
    versions.commit(append={"orders": orders.where("o_orderkey % 4 = 3")})
    last = versions.compact("orders")
    found = lambda rows, name, key: rows.agg(F.lit(name).alias("reader"), F.count(F.lit(1)).alias("n_rows"), F.max(key).alias("top"))
    return found(first.table("orders"), "opened before", "o_orderkey").unionAll(found(last.table("orders"), "opened after", "o_orderkey")).unionAll(found(last.table("people"), "customers of both", "c_custkey"))


@tool("user_id:l ts:z event_id:l event_type:s", "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scan_latest_bucketed(t):
    events = bucketed.bucketed(t("events").select("user_id", "ts", "event_id", "event_type"), "events", "user_id", ["ts", "event_id"])
    return bucketed.newest(events, "user_id", ["ts", "event_id"])


@tool("c_custkey:l c_name:s n_orders:l revenue:d", "SELECT c_custkey, c_name, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def join_bucketed(t):
    """Join and aggregate of two tables in the same buckets."""
    people = bucketed.bucketed(t("customer").select("c_custkey", "c_name"), "customer", "c_custkey")
    orders = bucketed.bucketed(t("orders").select("o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice")), "orders", "o_custkey")
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("revenue"))
    return people.hint("merge").join(totals, people["c_custkey"] == totals["o_custkey"]).drop("o_custkey")


# Rows that come late.


@tool("day:t event_type:s n:l", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_late_rows(t):
    """Events that arrive in three files over the same days, so that most come after their days were closed."""
    events, spark = t("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), t("events").sparkSession
    folder = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    for part in ("event_id % 4 = 1", "event_id % 2 = 0", "event_id % 4 = 3"):
        events.where(part).orderBy("ts").coalesce(1).write.mode("append").parquet(folder)  # files are read in this order
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return daily_with_late(stream)[0]


# Single faults in a copy.

ONE_OFFS = (
    OneOff("invented", "invented", 5), OneOff("deleted", "deleted", 6), OneOff("overwritten", "changed", 8, "o_orderpriority", "'0-NONE'"), OneOff("lowered", "changed", 8, "o_orderstatus", "lower({c})"),
    OneOff("padded", "changed", 6, "o_orderpriority", "concat({c}, ' ')"), OneOff("cent", "changed", 6, "o_totalprice", "{c} + 0.01"), OneOff("shifted", "changed", 5, "o_orderdate", "{c} + INTERVAL '2' HOUR"),
)
FOUND_AS = {"invented": "extra", "deleted": "missing", "changed": "changed"}
ONE_OFF_SQL = " UNION ALL ".join(
    "SELECT 'invented' AS fault, CAST((SELECT max(o_orderkey) FROM orders) + 1000000 + n AS VARCHAR) AS row_key, 'extra' AS kind FROM range(1, 6) r(n)" if f.kind == "invented" else
    f"SELECT * FROM (SELECT '{f.name}', CAST(o_orderkey AS VARCHAR), '{FOUND_AS[f.kind]}' FROM orders ORDER BY CAST(concat('0x', substr(md5(concat('7:{f.name}:', o_orderkey)), 1, 8)) AS BIGINT), o_orderkey LIMIT {f.rows})"
    for f in ONE_OFFS
)


@tool("fault:s row_key:s kind:s", ONE_OFF_SQL)
def faults_one_off(t):
    """What a comparison finds of each fault alone in a copy of the orders, and nothing of it once it is repaired."""
    orders = t("orders").selectExpr("o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_totalprice AS DECIMAL(12,2)) o_totalprice", "o_orderdate")
    rules = {"o_orderkey": Rule("int"), "o_orderstatus": Rule("text"), "o_orderpriority": Rule("text"), "o_totalprice": Rule("decimal"), "o_orderdate": Rule("ts")}
    keyed = lambda rows: reconcile.hashed(rows, ["o_orderkey"], rules)
    source, out = keyed(orders), []
    for fault in ONE_OFFS:
        damaged, truth = faults.planted(orders, "o_orderkey", fault, 7)
        after = faults.repaired(damaged, orders, "o_orderkey", truth)
        for name, rows in ((fault.name, damaged), (f"{fault.name}, repaired", after)):
            out.append(reconcile.row_differences(source, keyed(rows)).select(F.lit(name).alias("fault"), "row_key", "kind"))
    return reduce(DataFrame.unionAll, out)
