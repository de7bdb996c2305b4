"""Queries that apply the operators to the test tables: (plan, result columns, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions.money import boundaries, ratio
from lakeloom.operators import bitmaps, cost, graph, incremental, quality, selection, timeline
from lakeloom.operators import reconcile as rec
from lakeloom.session import stored

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]
TOOLS: dict[str, tuple[Plan, str, str | None]] = {}


def tool(spec: str, sql: str | None):
    def add(f: Plan) -> Plan:
        TOOLS[f.__name__] = (f, spec, sql)
        return f

    return add


def opened(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def n_rows():
    return F.count(F.lit(1))


# Relational forms.


@tool("user_id:l event_id:l event_type:s", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def scan_latest_per_key(t):
    newest = F.max(F.struct("ts", "event_id", "event_type")).alias("_e")  # an aggregate: partial maxima, no sort
    return t("events").groupBy("user_id").agg(newest).select("user_id", "_e.event_id", "_e.event_type")


@tool("o_custkey:l n:l", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY ALL")
def join_semi_distinct(t):
    return t("orders").join(t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").groupBy("o_custkey").agg(n_rows().alias("n"))


@tool("o_orderkey:l o_custkey:l", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_anti_orphans(t):
    return t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@tool("day:t n:l", "SELECT CAST(d AS DATE) AS day, count(event_id) AS n FROM range(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) r(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) AND event_type = 'purchase' AND value > 0 GROUP BY ALL")
def spine_left_join(t):
    events = t("events").where("event_type = 'purchase' AND value > 0").groupBy(F.to_date("ts").alias("day")).agg(n_rows().alias("n"))
    days = events.sparkSession.range(1).select(F.explode(F.expr("sequence(DATE '2023-12-25', DATE '2024-02-04', INTERVAL 1 DAY)")).alias("day"))
    return days.join(events, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@tool("purchase_id:l touch_id:l", "SELECT p.event_id AS purchase_id, c.event_id AS touch_id FROM events p JOIN events c ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL 7 DAYS WHERE p.event_type = 'purchase' AND c.event_type = 'click' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.event_id DESC) = 1")
def asof_last_touch(t):
    """Last click within 7 days before each purchase: clicks and purchases of a user on one time line, on which the last
    click is carried forward over the borders of time ranges, so a busy user is spread over tasks."""
    rows = t("events").where("event_type IN ('purchase', 'click')").select("user_id", "ts", "event_id", (F.col("event_type") != "click").alias("_asks"))
    rows = rows.withColumn("_touch", F.when(~F.col("_asks"), F.struct("ts", "event_id")))
    seen = timeline.carried(rows, ["user_id"], ["ts", "_asks", "event_id"], "_touch", "_last").where("_asks")
    fresh = F.col("_last.ts") > F.col("ts") - F.expr("INTERVAL '7' DAY")
    return seen.where(fresh).select(F.col("event_id").alias("purchase_id"), F.col("_last.event_id").alias("touch_id"))


@tool("event_type:s p95:d", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def agg_p95(t):
    return selection.quantile(t("events").select("event_type", "value"), ["event_type"], "value", (95, 100)).withColumnRenamed("value", "p95")


@tool("event_type:s middle:d", "SELECT event_type, median(value) AS middle FROM events GROUP BY ALL")
def agg_median(t):
    return selection.median(t("events").select("event_type", "value"), ["event_type"], "value").withColumnRenamed("value", "middle")


PERIODS = "SELECT 'day' AS grain, CAST(ts AS DATE) AS period, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL UNION ALL SELECT 'week', CAST(date_trunc('week', ts) AS DATE), event_type, count(DISTINCT user_id) FROM events GROUP BY ALL UNION ALL SELECT 'month', CAST(date_trunc('month', ts) AS DATE), event_type, count(DISTINCT user_id) FROM events GROUP BY ALL UNION ALL SELECT 'all', NULL, NULL, count(DISTINCT user_id) FROM events"


@tool("grain:s period:t event_type:s n:l", PERIODS)
def agg_distinct_rollup(t):
    """Users by day, week and month and in all, from one table of bits a day."""
    days = stored(bitmaps.daily(t("events"), ["event_type"], F.to_date("ts"), "user_id"), "daily-users")
    grains = {"day": F.col("day"), "week": F.trunc("day", "week"), "month": F.trunc("day", "month")}
    parts = [bitmaps.rolled(days, ["event_type"], period).select(F.lit(grain).alias("grain"), "period", "event_type", "n") for grain, period in grains.items()]
    every = bitmaps.rolled(days, [], F.lit(None).cast("date"))
    return reduce(DataFrame.unionAll, parts).unionByName(every.select(F.lit("all").alias("grain"), "period", F.lit(None).cast("string").alias("event_type"), "n"))


@tool("o_orderpriority:s F:l O:l P:l", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
def agg_pivot(t):
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(n_rows()).na.fill(0)


@tool("o_orderpriority:s o_orderstatus:s n:l", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def agg_rollup(t):
    return t("orders").rollup("o_orderpriority", "o_orderstatus").agg(n_rows().alias("n"))


@tool("c_mktsegment:s c_custkey:l rank:l", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 20")
def topn_per_group(t):
    rank = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t("customer").withColumn("rank", rank).where("rank <= 20")


@tool("key:l", "SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders")
def union_distinct(t):
    return t("customer").select(F.col("c_custkey").alias("key")).union(t("orders").select("o_custkey")).distinct()


@tool("key:l", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t):
    return t("customer").select(F.col("c_custkey").alias("key")).intersect(t("orders").select("o_custkey"))


@tool("key:l", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_except(t):
    return t("orders").select(F.col("o_orderkey").alias("key")).subtract(t("lineitem").select("l_orderkey"))


@tool("event_id:l ts:z", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAYS")
def scalar_subquery_filter(t):
    newest = F.broadcast(t("events").agg(F.max("ts").alias("_newest")))  # one row
    return t("events").crossJoin(newest).where(F.col("ts") > F.col("_newest") - F.expr("INTERVAL '3' DAY"))


@tool("o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@tool("event_id:l k:l", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@tool("o_orderkey:l step:l", "SELECT o_orderkey, unnest(range(o_orderkey % 4)) AS step FROM orders")
def explode_sequence(t):
    n = F.col("o_orderkey") % 4
    return t("orders").where(n > 0).select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("step"))


@tool("week:s n:l", "SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY ALL")
def iso_week(t):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    return t("orders").groupBy(week.alias("week")).agg(n_rows().alias("n"))


@tool("event_id:l hours:l months:l", "SELECT event_id, date_diff('hour', TIMESTAMP '2023-11-30 22:40:00', ts) AS hours, date_diff('month', TIMESTAMP '2023-11-30 22:40:00', ts) AS months FROM events")
def date_diff_boundaries(t):
    base = F.lit("2023-11-30 22:40:00").cast("timestamp_ntz")
    return t("events").select("event_id", boundaries("hour", base, F.col("ts")).alias("hours"), boundaries("month", base, F.col("ts")).alias("months"))


@tool("c_custkey:l redacted:s", "SELECT c_custkey, regexp_replace(regexp_replace(concat('select * from t where name = ''', c_name, ''' and k = ', c_custkey), '''[^'']*''', '?', 'g'), '\\b[0-9]+\\b', '?', 'g') AS redacted FROM customer")
def str_redact_literals(t):
    text = F.concat(F.lit("select * from t where name = '"), "c_name", F.lit("' and k = "), F.col("c_custkey").cast("string"))
    return t("customer").select("c_custkey", F.regexp_replace(F.regexp_replace(text, r"'[^']*'", "?"), r"\b[0-9]+\b", "?").alias("redacted"))


@tool("o_orderkey:l truncated:d", "SELECT o_orderkey, floor(o_totalprice * 100) / 100 AS truncated FROM orders")
def float_truncate(t):
    return t("orders").select("o_orderkey", (F.floor(F.col("o_totalprice") * 100) / 100).alias("truncated"))


@tool("event_id:l utc:z", "SELECT event_id, ts + INTERVAL 5 HOURS AS utc FROM events")  # all events are of one January
def tz_reinterpret(t):
    return t("events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("utc"))


# Quality.

DOCTORED = "(SELECT * REPLACE (CASE WHEN ts > m - INTERVAL 24 HOURS AND event_id % 2 = 0 THEN NULL ELSE value END AS value, CASE WHEN ts > m - INTERVAL 24 HOURS AND event_id % 5 = 0 THEN 'refund' ELSE event_type END AS event_type) FROM events, (SELECT max(ts) AS m FROM events) WHERE NOT (ts > m - INTERVAL 24 HOURS AND event_id % 4 < {drop} AND ts < m))"


def doctored(t, drop: int = 0) -> DataFrame:
    """Events whose last 24 hours lack some rows, have nulls and an unknown type."""
    rows = t("events").crossJoin(F.broadcast(t("events").agg(F.max("ts").alias("_m"))))
    last = F.col("ts") > F.col("_m") - F.expr("INTERVAL '24' HOUR")
    rows = rows.where(~(last & (F.col("event_id") % 4 < drop) & (F.col("ts") < F.col("_m"))))
    return rows.withColumns({
        "value": F.when(last & (F.col("event_id") % 2 == 0), F.lit(None)).otherwise(F.col("value")),
        "event_type": F.when(last & (F.col("event_id") % 5 == 0), "refund").otherwise(F.col("event_type")),
    }).drop("_m")


AGED = "SELECT *, (epoch_us((SELECT max(ts) FROM {0} z)) - epoch_us(ts)) // 86400000000 AS d FROM {0} y"


@tool("today:l usual:d", f"SELECT today, usual FROM (SELECT sum(n) FILTER (WHERE i = 0) AS today, median(n) FILTER (WHERE i > 0) AS usual FROM (SELECT i, count(d) AS n FROM range(8) r(i) LEFT JOIN ({AGED.format(DOCTORED.format(drop=3))}) e ON e.d = i GROUP BY ALL)) WHERE usual >= 10 AND today < 0.5 * usual")
def test_recent_volume(t):
    return quality.recent_volume(doctored(t, 3), "ts")


@tool("column_name:s today_share:d usual_share:d", f"SELECT column_name, today_share, usual_share FROM (SELECT 'value' AS column_name, any_value(s) FILTER (WHERE d = 0) AS today_share, median(s) FILTER (WHERE d > 0) AS usual_share, any_value(n) FILTER (WHERE d = 0) AS n FROM (SELECT d, count(*) AS n, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM ({AGED.format(DOCTORED.format(drop=0))}) WHERE d <= 7 GROUP BY ALL)) WHERE today_share - usual_share > 0.2 AND (today_share - usual_share) * sqrt(n) > 4 * sqrt(greatest(usual_share * (1 - usual_share), 1e-9)) AND n >= 10")
def test_column_profile_nulls(t):
    return quality.null_profile(doctored(t), "ts", ["event_id", "user_id", "event_type", "value"])


@tool("today_rows:l new_rows:l", f"SELECT count(*) AS today_rows, count(*) FILTER (WHERE event_type NOT IN (SELECT event_type FROM ({AGED.format(DOCTORED.format(drop=0))}) WHERE d BETWEEN 1 AND 7)) AS new_rows FROM ({AGED.format(DOCTORED.format(drop=0))}) WHERE d = 0 HAVING new_rows > 0.1 * today_rows AND today_rows >= 10")
def test_column_profile_new_values(t):
    return quality.new_values(doctored(t), "ts", "event_type")


@tool("l_orderkey:l l_linenumber:l n_rows:l", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING n_rows > 1")
def test_unique_combination(t):
    return quality.unique_combination(t("lineitem"), "l_orderkey", "l_linenumber")


@tool("n_rows:l", "SELECT count(*) AS n_rows FROM nation HAVING n_rows < 30 OR n_rows > 60")
def test_row_count_in_range(t):
    return quality.row_count_in_range(t("nation"), 30, 60)


@tool("c_custkey:l", "SELECT c_custkey FROM customer WHERE sign(c_acctbal) = -1")
def test_non_negative(t):
    return quality.non_negative(t("customer"), "c_acctbal")


@tool("event_id:l", f"SELECT event_id FROM {DOCTORED.format(drop=0)} WHERE value IS NULL")
def test_not_null(t):
    return quality.not_null(doctored(t), "value")


@tool("o_orderstatus:s n_rows:l", "SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus != 'F' AND o_orderstatus != 'O' GROUP BY ALL")
def test_accepted_values(t):
    return quality.accepted_values(t("orders"), "o_orderstatus", "F", "O")


@tool("l_partkey:l l_orderkey:l", "SELECT l_partkey, l_orderkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 10)")
def test_relationships(t):
    return quality.relationships(t("lineitem"), "l_partkey", t("part").where("p_size > 10"), "p_partkey")


@tool("max_loaded_at:z age_hours:d status:s", "SELECT max(ts) AS max_loaded_at, epoch(TIMESTAMP '2024-02-01 12:00:00' - max(ts)) // 1 / 3600.0 AS age_hours, CASE WHEN age_hours > 48 THEN 'error' WHEN age_hours > 24 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def source_freshness(t):
    rows = t("events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return quality.freshness(rows, "ts", F.lit("2024-02-01 12:00:00"))


# History.


@tool("user_id:l event_id:l valid_from:z valid_to:z", "SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)")
def snapshot_scd2(t):
    first = t("events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return incremental.snapshot(first, "user_id", "ts")


@tool("event_id:l", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 MINUTES AND ts <= TIMESTAMP '2024-01-16 00:00:00'")
def load_window(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return incremental.load_window(t("events"), "ts", at("2024-01-15 00:00:00"), at("2024-01-16 00:00:00"))


@tool("o_orderkey:l", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) >= (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH FROM orders)")
def rebuild_recent_months(t):
    newest = F.broadcast(t("orders").agg(F.max("o_orderdate").alias("_newest")))  # one row
    return incremental.recent_months(t("orders").crossJoin(newest), "o_orderdate", F.col("_newest"))


# Reconciliation: orders against a migrated copy with planted defects.

RULES = {"o_orderkey": rec.Rule("int"), "o_orderstatus": rec.Rule("text"), "o_orderpriority": rec.Rule("text"), "o_totalprice": rec.Rule("decimal"), "o_orderdate": rec.Rule("ts")}
SOURCE = "SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderdate FROM orders"
TARGET = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 1 THEN concat(o_orderstatus, '  ') WHEN o_orderkey % 13 = 2 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, "
    "o_orderpriority, CAST(CASE WHEN o_orderkey % 17 = 3 THEN o_totalprice + 0.01 WHEN o_orderkey % 19 = 4 THEN o_totalprice + 5 ELSE o_totalprice END AS DECIMAL(12,2)) AS o_totalprice, "
    "o_orderdate + INTERVAL '1' HOUR * (CASE WHEN o_orderkey % 23 = 5 THEN 5 ELSE 0 END) AS o_orderdate FROM orders CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2) WHERE o_orderkey % 97 <> 6 AND (copy = 1 OR o_orderkey % 101 = 7) "
    "UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)), o_orderdate FROM orders WHERE o_orderkey % 211 = 8"
)
TEXT = "concat_ws('|', CAST(o_orderkey AS VARCHAR), replace(replace(o_orderstatus, '\\', '\\\\'), '|', '\\|'), o_orderpriority, CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ'))"
HEX = "CAST(concat('0x', substr({0}, {1}, 8)) AS BIGINT)"


def sides(t) -> tuple[DataFrame, DataFrame]:
    orders = t("orders")
    source = orders.selectExpr("o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_totalprice AS DECIMAL(12,2)) o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")
    status = F.when(key % 13 == 1, F.concat("o_orderstatus", F.lit("  "))).when(key % 13 == 2, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    cents = F.when(key % 17 == 3, F.lit("0.01")).when(key % 19 == 4, F.lit("5.00")).otherwise(F.lit("0")).cast("decimal(12,2)")
    hours = F.expr("INTERVAL '1' HOUR * (CASE WHEN o_orderkey % 23 = 5 THEN 5 ELSE 0 END)")
    moved = source.withColumns({"o_orderstatus": status, "o_totalprice": (F.col("o_totalprice") + cents).cast("decimal(12,2)"), "o_orderdate": F.col("o_orderdate") + hours})
    kept = moved.where("o_orderkey % 97 <> 6")
    invented = source.where("o_orderkey % 211 = 8").withColumn("o_orderkey", -key - 1)
    target = kept.unionAll(kept.where("o_orderkey % 101 = 7")).unionAll(invented)
    return tuple(rec.hashed(x, ["o_orderkey"], RULES) for x in (source, target))


@tool("o_orderkey:l row_text:s bucket:l h1:l h2:l", f"SELECT o_orderkey, {TEXT} AS row_text, {HEX.format('md5(CAST(o_orderkey AS VARCHAR))', 1)} AS bucket, {HEX.format('md5(row_text)', 1)} AS h1, {HEX.format('md5(row_text)', 9)} AS h2 FROM ({SOURCE})")
def canonical_rows(t):
    return sides(t)[0]


@tool("o_orderkey:l row_text:s", f"SELECT o_orderkey, concat_ws('|', CAST(o_orderkey AS VARCHAR), lower(rtrim(s, ' ')), CAST(CAST(round(o_totalprice, 1) AS DECIMAL(12,1)) AS VARCHAR)) AS row_text FROM (SELECT o_orderkey, concat('Ä', o_orderstatus, 'x  ') AS s, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice FROM orders)")
def canonical_rows_lenient(t):
    """Trailing blanks and NULs and case forgiven, money at one digit."""
    rows = t("orders").select("o_orderkey", F.concat(F.lit("Ä"), "o_orderstatus", F.lit("x  \u0000\u0000")).alias("s"), F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    return rec.hashed(rows, ["o_orderkey"], {"o_orderkey": rec.Rule("int"), "s": rec.Rule("text", rtrim=True, casefold=True), "o_totalprice": rec.Rule("decimal", scale=1)})


@tool("moved:l naive:l saved_share:d", f"SELECT 2 * n + f AS moved, a + b AS naive, round(1 - (2 * n + f) / (a + b), 6) AS saved_share FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM ({TARGET})) AS b, (SELECT count(DISTINCT {HEX.format('md5(CAST(o_orderkey AS VARCHAR))', 1)} >> 28) FROM orders) AS n, (SELECT count(*) FROM orders) + (SELECT count(*) FROM ({TARGET})) AS f)")
def transfer_accounting(t):
    source, target = sides(t)
    a, b, levels = rec.descend(source, target, max_depth=1)
    counts = source.agg(n_rows().alias("a")).crossJoin(target.agg(n_rows().alias("b"))).crossJoin(a.agg(n_rows().alias("c"))).crossJoin(b.agg(n_rows().alias("d"))).first()  # one row each
    return rec.transfers(levels, F.lit(counts["a"]), F.lit(counts["b"]), F.lit(counts["c"] + counts["d"]))


NEED, READS = (("r", "revenue"), ("s", "revenue"), ("s", "orders"), ("u", "x"), ("v", "x")), tuple((r, c, "orders", k) for r in "rs" for c, k in (("revenue", "o_totalprice"), ("revenue", "o_orderpriority"), ("orders", "o_orderpriority")))


@tool("report:s explained:b causes:s", "SELECT * FROM (VALUES ('r', TRUE, 'orders.o_totalprice'), ('s', FALSE, 'orders.o_totalprice'), ('u', TRUE, 'orders'), ('v', FALSE, '')) v(report, explained, causes)")
def report_explanations(t):
    """What the differing cells explain: the status and price differ, the priority does not."""
    make = t("region").sparkSession.createDataFrame
    found = cells(t).select(F.lit("orders").alias("table_name"), F.col("column_name").alias("source_column")).distinct()
    lineage = make(list(READS), "report string, column_name string, table_name string, source_column string")
    out = rec.explained(make(list(NEED), "report string, column_name string"), lineage, make([("u", "orders"), ("v", "tickets")], "report string, table_name string"), found)
    return out.withColumn("causes", F.array_join("causes", ","))


WALL = "ts + INTERVAL '1' DAY * (event_id % 300)"
SUMMER, REPEATED = "wall >= TIMESTAMP '2024-03-10 03:00:00' AND wall < TIMESTAMP '2024-11-03 02:00:00'", "wall >= TIMESTAMP '2024-11-03 01:00:00' AND wall < TIMESTAMP '2024-11-03 02:00:00'"
SKIPPED = "wall >= TIMESTAMP '2024-03-10 02:00:00' AND wall < TIMESTAMP '2024-03-10 03:00:00'"


@tool("event_id:l first:z second:z", f"SELECT event_id, wall + INTERVAL '1' HOUR * (CASE WHEN {SUMMER} THEN 4 ELSE 5 END) AS first, CASE WHEN {REPEATED} THEN wall + INTERVAL '5' HOUR END AS second FROM (SELECT event_id, {WALL} AS wall FROM events) WHERE NOT ({SKIPPED})")
def tz_both_folds(t):
    """The instants that a wall clock time in New York can mean: two in the hour that the clocks repeat; times in the hour
    that they skip are left out."""
    rows = t("events").select("event_id", F.expr(WALL).alias("wall")).where(f"NOT ({SKIPPED})").withColumn("wall", F.col("wall").cast("timestamp"))
    one, two = rec.other_fold(F.col("wall"), "America/New_York")
    return rows.select("event_id", F.least(one, F.coalesce(two, one)).alias("first"), F.when(two.isNotNull(), F.greatest(one, two)).alias("second"))


@tool("segment:l n_rows:l h1:l h2:l", f"SELECT {HEX.format('md5(CAST(o_orderkey AS VARCHAR))', 1)} >> 24 AS segment, count(*) AS n_rows, sum({HEX.format(f'md5({TEXT})', 1)}) AS h1, sum({HEX.format(f'md5({TEXT})', 9)}) AS h2 FROM ({SOURCE}) GROUP BY ALL")
def segment_summary(t):
    return rec.summary(sides(t)[0], 2)


DIFF = f"SELECT * FROM (SELECT row_key, ifnull(a.n, 0) AS n_source, ifnull(b.n, 0) AS n_target, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate_key' WHEN a.x <> b.x THEN 'changed' END AS kind FROM (SELECT CAST(o_orderkey AS VARCHAR) AS row_key, count(*) AS n, min({TEXT}) AS x FROM ({SOURCE}) GROUP BY ALL) a FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS row_key, count(*) AS n, min({TEXT}) AS x FROM ({TARGET}) GROUP BY ALL) b USING (row_key)) WHERE kind IS NOT NULL"


@tool("row_key:s n_source:l n_target:l kind:s", DIFF)
def diff_rows(t):
    return rec.row_differences(*sides(t))


@tool("row_key:s n_source:l n_target:l kind:s", DIFF)
def diff_segmented(t):
    source, target, _ = rec.descend(*sides(t))
    return rec.row_differences(source, target)


@tool("level:l n_segments:l n_rows:l", f"SELECT 1 AS level, count(DISTINCT g) AS n_segments, count(*) AS n_rows FROM (SELECT {HEX.format('md5(CAST(o_orderkey AS VARCHAR))', 1)} >> 28 AS g FROM orders)")
def diff_levels(t):
    source, target = sides(t)
    return rec.descend(source, target.where("o_orderkey >= 0").unionAll(target.where("o_orderkey < 0")), max_depth=1)[2]


#: 2 am of the first Sunday of April to 2 am of the last of October, as it was in those years.
SUMMER = "({0} >= make_date(year({0}), 4, 1) + CAST((7 - dayofweek(make_date(year({0}), 4, 1))) % 7 AS INTEGER) + INTERVAL 2 HOURS AND {0} < make_date(year({0}), 10, 31) - CAST(dayofweek(make_date(year({0}), 10, 31)) AS INTEGER) + INTERVAL 1 HOUR)"
ONCE = f"(SELECT * FROM (SELECT a.*, b.o_orderstatus AS s2, b.o_totalprice AS p2, b.o_orderdate AS t2, count(*) OVER (PARTITION BY a.o_orderkey) AS n FROM ({SOURCE}) a JOIN ({TARGET}) b USING (o_orderkey)) WHERE n = 1)"
CLASSES = f"""(SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'o_orderstatus' AS column_name, CASE WHEN trim(s2) = o_orderstatus THEN 'whitespace' ELSE 'case_only' END AS class FROM {ONCE} WHERE s2 <> o_orderstatus
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice', CASE WHEN p2 - o_totalprice = 0.01 AND trunc(CAST(p2 AS DOUBLE) * 100) = o_totalprice * 100 THEN 'rounding' ELSE 'value_mismatch' END FROM {ONCE} WHERE p2 <> o_totalprice
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderdate', CASE WHEN {SUMMER.format('o_orderdate')} THEN 'value_mismatch' ELSE 'timezone_shift' END FROM {ONCE} WHERE t2 <> o_orderdate)"""


def cells(t) -> DataFrame:
    return rec.classified(rec.cell_differences(*sides(t), RULES))


@tool("row_key:s column_name:s class:s", f"SELECT * FROM {CLASSES}")
def classify_mismatch(t):
    return cells(t)


@tool("row_key:s column_name:s class:s", f"SELECT row_key, NULL AS column_name, kind AS class FROM ({DIFF}) WHERE kind <> 'changed' UNION ALL SELECT * FROM {CLASSES}")
def discrepancy_stream(t):
    return rec.discrepancies(rec.row_differences(*sides(t)), cells(t))


@tool("column_name:s n_differing:l match_rate:d", f"SELECT c AS column_name, count(class) AS n_differing, round(1 - count(class) / (SELECT count(*) FROM {ONCE}), 6) AS match_rate FROM (SELECT unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_orderdate']) AS c) LEFT JOIN {CLASSES} ON column_name = c GROUP BY ALL")
def column_match_rates(t):
    source, target = sides(t)
    both = rec.single(source).join(rec.single(target), "row_key", "left_semi").agg(n_rows().alias("_both"))  # one row
    found = rec.column_rates(cells(t).select("column_name", "class").withColumn("_", F.lit(0)), F.lit(None), ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    rate = F.round(1 - F.col("n_differing") / F.nullif(F.col("_both"), F.lit(0)), 6)
    return found.crossJoin(F.broadcast(both)).withColumn("match_rate", rate)


@tool("class:s n:l max_n:l passes:b", f"SELECT k AS class, count(class) AS n, m AS max_n, count(class) <= m AS passes FROM (VALUES ('rounding', 0), ('whitespace', 100000), ('timezone_shift', 10), ('missing', 5)) v(k, m) LEFT JOIN (SELECT class FROM {CLASSES} UNION ALL SELECT kind FROM ({DIFF}) WHERE kind <> 'changed') ON class = k GROUP BY k, m")
def class_limits(t):
    return rec.class_limits(discrepancy_stream(t), {"rounding": 0, "whitespace": 100_000, "timezone_shift": 10, "missing": 5})


TRUTH = f"(SELECT row_key, column_name, CASE WHEN CAST(row_key AS BIGINT) % 2 = 0 THEN class ELSE 'value_mismatch' END AS class FROM {CLASSES} WHERE CAST(row_key AS BIGINT) % 3 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderpriority', 'case_only' FROM orders WHERE o_orderkey % 500 = 0)"


@tool("expected:l detected:l true_positives:l correctly_classified:l equivalent_under_policy:l recall:d precision:d accuracy:d", f"SELECT expected, detected, hit AS true_positives, correct AS correctly_classified, same AS equivalent_under_policy, round(hit / expected, 6) AS recall, round(hit / detected, 6) AS precision, round(correct / hit, 6) AS accuracy FROM (SELECT (SELECT count(*) FROM {TRUTH} WHERE NOT (column_name = 'o_orderstatus' AND class = 'case_only')) AS expected, (SELECT count(*) FROM {CLASSES}) AS detected, (SELECT count(*) FROM {TRUTH} x JOIN {CLASSES} y USING (row_key, column_name) WHERE NOT (column_name = 'o_orderstatus' AND x.class = 'case_only')) AS hit, (SELECT count(*) FROM {TRUTH} x JOIN {CLASSES} y USING (row_key, column_name, class) WHERE NOT (column_name = 'o_orderstatus' AND x.class = 'case_only')) AS correct, (SELECT count(*) FROM {TRUTH} WHERE column_name = 'o_orderstatus' AND class = 'case_only') AS same)")
def grade_planted(t):
    found = cells(t).select("row_key", "column_name", "class")
    key = F.col("row_key").cast("long")
    planted = found.where(key % 3 != 0).withColumn("class", F.when(key % 2 == 0, F.col("class")).otherwise("value_mismatch"))
    more = t("orders").where("o_orderkey % 500 = 0").select(F.col("o_orderkey").cast("string").alias("row_key"), F.lit("o_orderpriority").alias("column_name"), F.lit("case_only").alias("class"))
    return rec.grade(planted.unionAll(more), found, {"o_orderstatus": {"case_only"}})


@tool("row_key:s kind:s", f"SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'in_flight' ELSE 'extra' END AS kind FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01' AND o_orderkey % 2 = 0 UNION ALL SELECT CAST(-o_orderkey - 1 AS VARCHAR), 'extra' FROM orders WHERE o_orderkey % 211 = 8")
def in_flight_rows(t):
    mark = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    source, _ = sides(t)
    late = F.col("o_orderdate") > mark
    invented = source.where("o_orderkey % 211 = 8").withColumn("row_key", (-F.col("o_orderkey") - 1).cast("string"))
    target = source.where(~(late & (F.col("o_orderkey") % 2 == 1))).unionAll(invented)
    found = rec.row_differences(rec.as_of(source, "o_orderdate", mark), target)
    return rec.without_in_flight(found, rec.in_flight(source, "o_orderdate", mark, ["row_key"]))


@tool("n_source:l n_target:l row_match_rate:d failures:s", f"SELECT s AS n_source, t AS n_target, round((s - m - d - c) / s, 6) AS row_match_rate, 'row match rate' AS failures FROM (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM ({TARGET})) AS t, (SELECT count(*) FROM ({DIFF}) WHERE kind = 'missing') AS m, (SELECT sum(n_source) FROM ({DIFF}) WHERE kind = 'duplicate_key') AS d, (SELECT count(DISTINCT row_key) FROM {CLASSES}) AS c)")
def pair_verdict(t):
    source, target = sides(t)
    counts = source.agg(n_rows().alias("a")).crossJoin(target.agg(n_rows().alias("b"))).first()
    out = rec.pair_verdict(rec.row_differences(source, target), cells(t), F.lit(counts["a"]), F.lit(counts["b"]), lag_hours=F.lit(3.0))
    return out.withColumn("failures", F.array_join("failures", ","))


@tool("night:l pair:s class:s row_key:s column_name:s example:l", f"SELECT CAST(row_key AS BIGINT) % 3 AS night, 'orders' AS pair, class, row_key, column_name, row_number() OVER (PARTITION BY CAST(row_key AS BIGINT) % 3, class ORDER BY row_key, column_name) AS example FROM {CLASSES} QUALIFY example <= 20")
def night_examples(t):
    found = cells(t).select((F.col("row_key").cast("long") % 3).alias("night"), F.lit("orders").alias("pair"), "row_key", "column_name", "class")
    return rec.night_record(found)[1]


@tool("night:l pair:s class:s n:l", f"SELECT CAST(row_key AS BIGINT) % 3 AS night, 'orders' AS pair, class, count(*) AS n FROM {CLASSES} GROUP BY ALL")
def night_counts(t):
    found = cells(t).select((F.col("row_key").cast("long") % 3).alias("night"), F.lit("orders").alias("pair"), "row_key", "column_name", "class")
    return rec.night_record(found)[0]


@tool("n_differing:l n_source:l match_rate:d passes:b", f"SELECT count(*) AS n_differing, (SELECT count(*) FROM orders) AS n_source, round(1 - count(*) / (SELECT count(*) FROM orders), 6) AS match_rate, round(1 - count(*) / (SELECT count(*) FROM orders), 6) >= 0.999 AS passes FROM ({DIFF})")
def verdict_rates(t):
    source, target = sides(t)
    n = F.broadcast(source.agg(n_rows().alias("_n")))  # one row
    rows = rec.row_differences(source, target).crossJoin(n)
    return rec.verdict(rows, F.max("_n"))


@tool("cutover_night:t", "SELECT min(day) AS cutover_night FROM (SELECT day, row_number() OVER (PARTITION BY g ORDER BY day) AS n FROM (SELECT day, bad, sum(bad) OVER (ORDER BY day) AS g FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, CASE WHEN day(ts) % 9 = 0 THEN 1 ELSE 0 END AS bad FROM events)) WHERE bad = 0) WHERE n = 7")
def cutover_streak(t):
    nights = t("events").select(F.to_date("ts").alias("day")).distinct().withColumn("clean", F.dayofmonth("day") % 9 != 0)
    return rec.clean_streak(nights, "day", "clean", 7)


# Cost.


@tool("month:s days:l usd:d", "SELECT month, days, round(310.0 * days / n, 12) AS usd FROM (SELECT strftime(d, '%Y-%m') AS month, count(*) AS days, any_value(day(last_day(d))) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY ALL)")
def month_pools(t):
    return cost.month_pools(t("orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "day", F.lit(310))


SHARE = "SELECT event_type, user_id, units::DOUBLE / 1e12 AS usd FROM (SELECT *, u + CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY w DESC, user_id) = 1 THEN 100000000000001 - sum(u) OVER (PARTITION BY event_type) ELSE 0 END AS units FROM (SELECT *, f + CASE WHEN 2 * r > s OR (2 * r = s AND f % 2 = 1) THEN 1 ELSE 0 END AS u FROM (SELECT *, (100000000000001::HUGEINT * w) // s AS f, (100000000000001::HUGEINT * w) % s AS r FROM (SELECT *, (sum(w) OVER (PARTITION BY event_type))::HUGEINT AS s FROM (SELECT event_type, user_id, count(*)::HUGEINT AS w FROM events GROUP BY event_type, user_id)))))"


@tool("event_type:s user_id:l usd:d", SHARE)
def share_exact(t):
    uses = t("events").groupBy("event_type", "user_id").agg(n_rows().alias("w")).withColumn("total", F.lit("100.000000000001").cast("decimal(20,12)"))
    return cost.share(uses, "total", "w", ["event_type"], "user_id")


def jobs(t) -> DataFrame:
    return t("events").select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("start"), (F.col("event_id") % 400 * 1000 + 1).alias("ms"))


JOBS = "SELECT event_type, event_id, epoch_us(ts) // 1000 AS start, event_id % 400 * 1000 + 1 AS ms FROM events"
CHAIN = f"""SELECT event_type, event_id, ms, c + max(start - c + ms) OVER w AS end_ms FROM (SELECT *, sum(ms) OVER (PARTITION BY event_type ORDER BY start, event_id) AS c FROM ({JOBS})) WINDOW w AS (PARTITION BY event_type ORDER BY start, event_id)"""
BURST = f"SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY start, event_id) AS burst FROM (SELECT x.*, j.start, CASE WHEN j.start <= lag(end_ms) OVER (PARTITION BY x.event_type ORDER BY j.start, x.event_id) + 300000 THEN 0 ELSE 1 END AS fresh FROM ({CHAIN}) x JOIN ({JOBS}) j USING (event_id))"


@tool("event_id:l end_ms:l burst:l", f"SELECT event_id, end_ms, burst FROM ({BURST})")
def warehouse_bursts(t):
    return cost.bursts(jobs(t), "event_type", "start", "event_id", "ms", 300_000)


@tool("event_type:s burst:l n_queries:l busy_ms:l seconds:l usd:d", f"SELECT event_type, burst, count(*) AS n_queries, sum(ms) AS busy_ms, greatest(60, CAST(ceil((max(end_ms) - min(end_ms - ms) + 300000) / 1000) AS BIGINT)) AS seconds, round(seconds * 3.0 / 3600, 6) AS usd FROM ({BURST}) GROUP BY event_type, burst")
def burst_billing(t):
    return cost.bill(cost.bursts(jobs(t), "event_type", "start", "event_id", "ms", 300_000), "event_type", "ms", 300_000, 60, 3.0)


@tool("event_id:l usd:d", f"SELECT event_id, CAST(u + CASE WHEN row_number() OVER (PARTITION BY event_type, burst ORDER BY ms DESC, event_id) = 1 THEN pool - sum(u) OVER (PARTITION BY event_type, burst) ELSE 0 END AS DOUBLE) / 1e12 AS usd FROM (SELECT *, f + CASE WHEN 2 * r > w OR (2 * r = w AND f % 2 = 1) THEN 1 ELSE 0 END AS u FROM (SELECT *, (pool * ms) // w AS f, (pool * ms) % w AS r FROM (SELECT x.event_type, x.burst, x.event_id, CAST(x.ms AS HUGEINT) AS ms, CAST(b.w AS HUGEINT) AS w, CAST(round(b.usd * 1e6) AS HUGEINT) * 1000000 AS pool FROM ({BURST}) x JOIN (SELECT event_type, burst, sum(ms) AS w, round(greatest(60, CAST(ceil((max(end_ms) - min(end_ms - ms) + 300000) / 1000) AS BIGINT)) * 3.0 / 3600, 6) AS usd FROM ({BURST}) GROUP BY event_type, burst) b USING (event_type, burst))))")
def burst_shares(t):
    rows = jobs(t).select(F.col("event_type").alias("warehouse"), F.col("event_id").alias("query_id"), "start", "ms")
    runs = cost.bursts(rows, "warehouse", "start", "query_id", "ms", 300_000)
    return cost.burst_shares(runs, cost.bill(runs, "warehouse", "ms", 300_000, 60, 3.0)).withColumnRenamed("query_id", "event_id")


@tool("o_orderkey:l billed_bytes:l usd:d", "SELECT l_orderkey AS o_orderkey, sum(greatest(l_partkey * 100000, 10485760)) AS billed_bytes, round(billed_bytes * 6.25 / 1099511627776.0, 9) AS usd FROM lineitem GROUP BY ALL")
def scan_pricing(t):
    logs = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey") * 100_000).alias("bytes"))
    return cost.scan_price(logs, "o_orderkey", "bytes")


UP2 = "CASE WHEN {0} <= 0 THEN 0 ELSE CAST(ceil({0} / pow(10, greatest(0, floor(log10({0})) - 1))) * pow(10, greatest(0, floor(log10({0})) - 1)) AS BIGINT) END"


@tool("user:s active_days:l p95_daily:l max_query:l daily_quota:l query_limit:l", f"SELECT event_type AS user, count(*) AS active_days, quantile_disc(n, 0.95) AS p95_daily, max(m) AS max_query, {UP2.format('(2 * quantile_disc(n, 0.95))')} AS daily_quota, {UP2.format('(2 * max(m))')} AS query_limit FROM (SELECT event_type, CAST(ts AS DATE) AS day, sum(event_id % 5000) AS n, max(event_id % 5000) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def usage_quotas(t):
    return cost.quotas(t("events").withColumn("bytes", F.col("event_id") % 5000), "event_type", "ts", "bytes")


HOT_SQL = "SELECT table_name, filter_column, count(*) AS reads, sum(r) AS rows, sum(b) AS bytes, CASE WHEN table_name = 'click' THEN concat('skip index on ', filter_column) WHEN filter_column = 'user_id' THEN 'sort key (user_id, ts)' ELSE concat('sort key (', filter_column, ', ts, user_id)') END AS suggestion FROM (SELECT event_type AS table_name, event_id % 10 * 10 AS r, event_id AS b, unnest(['user_id', concat('c', CAST(event_id % 3 AS VARCHAR))]) AS filter_column FROM events WHERE event_id % 10 >= 9 AND event_id % 4 < 2 AND event_id % 6 <> 1) GROUP BY ALL HAVING count(*) >= 2"


@tool("table_name:s filter_column:s reads:l rows:l bytes:l suggestion:s", HOT_SQL)
def scan_hotspots(t):
    kind = F.get(F.array(*[F.lit(k) for k in ("dashboard", "adhoc", "dbt", "ingestion")]), (F.col("event_id") % 4).cast("int"))
    two = F.when(F.col("event_id") % 6 == 1, F.array("event_type", F.lit("other"))).otherwise(F.array("event_type"))
    reads = t("events").select(
        kind.alias("actor_type"), two.alias("tables"), (F.col("event_id") % 10 * 10).alias("rows_scanned"), F.col("event_id").alias("bytes_scanned"),
        F.array(F.lit("user_id"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string"))).alias("filter_columns"),
    )
    tables = t("events").select(F.col("event_type").alias("table_name")).distinct()
    engine = F.when(F.col("table_name") == "click", "ReplacingMergeTree").otherwise("MergeTree")
    return cost.hotspots(reads, tables.withColumns({"table_rows": F.lit(100), "table_bytes": F.lit(1000), "sorting_key": F.lit("(ts, user_id)"), "engine": engine}))


# Lineage and incidents. What depends on what: nations on regions, customers and suppliers on nations, orders on their
# customer and the supplier of their first line.

EDGES = (("region", "n_regionkey", "nation", "n_nationkey", "nation", "TRUE"), ("nation", "c_nationkey", "customer", "c_custkey", "customer", "TRUE"), ("nation", "s_nationkey", "supplier", "s_suppkey", "supplier", "TRUE"), ("customer", "o_custkey", "order", "o_orderkey", "orders", "TRUE"), ("supplier", "l_suppkey", "order", "l_orderkey", "lineitem", "l_linenumber = 1"))
FAILS = (("nation", "n_nationkey", "nation", "n_nationkey % 6 = 1"), ("customer", "c_custkey", "customer", "c_acctbal < 0"), ("supplier", "s_suppkey", "supplier", "s_suppkey % 5 = 2"), ("order", "o_orderkey", "orders", "o_orderkey % 7 = 3"))
EDGE_SQL = "(" + " UNION ALL ".join(f"SELECT concat('{p}_', {pk}) AS parent_id, concat('{c}_', {ck}) AS child_id FROM {table} WHERE {where}" for p, pk, c, ck, table, where in EDGES) + ") e"
PATHS = f"WITH RECURSIVE p AS (SELECT parent_id AS ancestor, child_id AS node, 1 AS depth FROM {EDGE_SQL} UNION SELECT p.ancestor, e.child_id, depth + 1 FROM p JOIN {EDGE_SQL} ON e.parent_id = p.node) SELECT ancestor, node, min(depth) AS depth FROM p GROUP BY ALL"
FAILED_SQL = "(" + " UNION ALL ".join(f"SELECT concat('{kind}_', {key}) AS node FROM {table} WHERE {where}" for kind, key, table, where in FAILS) + ")"
RULES_TABLE = (("*", "platform"), ("customer_*", "sales"), ("customer_1*", "core"), ("*_?1", "ones"), ("order_*", "fulfilment"), ("order_??", "early"), ("nation_1?", "abroad"), ("supplier_*7", "lucky"))


def edges(t) -> DataFrame:
    return reduce(DataFrame.unionAll, [t(table).where(where).selectExpr(f"concat('{p}_', {pk}) AS parent_id", f"concat('{c}_', {ck}) AS child_id") for p, pk, c, ck, table, where in EDGES])


def failed(t) -> DataFrame:
    return reduce(DataFrame.unionAll, [t(table).where(where).selectExpr(f"concat('{kind}_', {key}) AS node") for kind, key, table, where in FAILS])


@tool("ancestor:s node:s depth:l", PATHS)
def lineage_closure(t):
    return graph.closure(edges(t))


@tool("node:s nearest:s", f"SELECT node, arg_min(ancestor, (depth, ancestor)) AS nearest FROM ({PATHS}) WHERE node IN {FAILED_SQL} AND ancestor IN {FAILED_SQL} GROUP BY ALL")
def nearest_failed_ancestor(t):
    return graph.nearest_failed(graph.closure(edges(t)), failed(t))


@tool("node:s root:s", f"WITH RECURSIVE n AS (SELECT node, arg_min(ancestor, (depth, ancestor)) AS up FROM ({PATHS}) WHERE node IN {FAILED_SQL} AND ancestor IN {FAILED_SQL} GROUP BY ALL), f AS {FAILED_SQL}, w AS (SELECT node, node AS root, 0 AS i FROM f UNION ALL SELECT w.node, n.up, i + 1 FROM w JOIN n ON n.node = w.root) SELECT node, arg_max(root, i) AS root FROM w GROUP BY ALL")
def incident_roots(t):
    return graph.roots(graph.closure(edges(t)), failed(t))


TIER = "CASE WHEN {0} LIKE 'nation%' THEN 10 WHEN {0} LIKE 'customer%' THEN 5 ELSE 1 END"


@tool("node:s consumers:l score:d severity:s", f"SELECT node, consumers, score, CASE WHEN score >= 150 THEN 'SEV1' WHEN score >= 45 THEN 'SEV2' ELSE 'SEV3' END AS severity FROM (SELECT c.node, count(p.node) AS consumers, 3 * {TIER.format('c.node')} + ifnull(sum({TIER.format('p.node')}) FILTER (WHERE p.node IS NOT NULL), 0) AS score FROM (SELECT DISTINCT child_id AS node FROM {EDGE_SQL}) c LEFT JOIN ({PATHS}) p ON p.ancestor = c.node GROUP BY c.node)")
def incident_severity(t):
    nodes = graph.dealt(edges(t).select(F.col("child_id").alias("node")), edges(t).count(), "node").distinct()
    weight = F.when(F.col("node").startswith("nation"), 10).when(F.col("node").startswith("customer"), 5).otherwise(1)
    return graph.scored(graph.closure(edges(t)), nodes.withColumns({"weight": weight, "kind": F.lit("model")}))


@tool("node:s match:s owner:s ambiguous:b", "SELECT node, match, owner, count(*) FILTER (WHERE k = 1) OVER (PARTITION BY node) > 1 AS ambiguous FROM (SELECT node, match, owner, rank() OVER (PARTITION BY node ORDER BY lit DESC, wild) AS k, row_number() OVER (PARTITION BY node ORDER BY lit DESC, wild, match) AS r FROM (SELECT node, match, owner, len(regexp_replace(match, '[^*?]', '', 'g')) AS wild, len(match) - wild AS lit FROM (SELECT DISTINCT child_id AS node FROM " + EDGE_SQL + ") d JOIN (VALUES " + ", ".join(f"('{m}', '{o}')" for m, o in RULES_TABLE) + ") r(match, owner) ON node GLOB match)) QUALIFY r = 1")
def ownership_resolve(t):
    nodes = edges(t).select(F.col("child_id").alias("node")).distinct()
    return graph.resolve(nodes, t("region").sparkSession.createDataFrame(list(RULES_TABLE), "match string, owner string"))


ALERTS = "SELECT event_id, user_id, ts AS opened_at, ts + INTERVAL '1' MINUTE * (event_id % 3000) AS closed_at, CASE WHEN event_id % 10 = 0 THEN 'SEV1' WHEN event_id % 10 < 4 THEN 'SEV2' ELSE 'SEV3' END AS severity FROM events WHERE event_type = 'error'"


def alerts(t) -> DataFrame:
    name = F.when(F.col("event_id") % 10 == 0, "SEV1").when(F.col("event_id") % 10 < 4, "SEV2").otherwise("SEV3")
    return t("events").where("event_type = 'error'").select(
        "event_id", "user_id", F.col("ts").alias("opened_at"), F.expr("ts + INTERVAL '1' MINUTE * (event_id % 3000)").alias("closed_at"), name.alias("severity")
    )


@tool("severity:s incidents:l mttr_hours:d", f"SELECT ifnull(severity, 'all') AS severity, count(*) AS incidents, round(sum(event_id % 3000) / 60.0 / count(*), 4) AS mttr_hours FROM ({ALERTS}) GROUP BY ROLLUP (severity)")
def incident_mttr(t):
    minutes = boundaries("minute", "opened_at", "closed_at")
    rows = alerts(t).rollup("severity").agg(n_rows().alias("incidents"), ratio(F.sum(minutes), 60 * n_rows()).alias("mttr_hours"))
    return rows.withColumn("severity", F.coalesce("severity", F.lit("all")))


@tool("event_id:l root:s previous:l", f"SELECT event_id, concat('m', CAST(user_id % 10 AS VARCHAR)) AS root, lag(event_id) OVER (PARTITION BY user_id % 10 ORDER BY opened_at, event_id) AS previous FROM ({ALERTS})")
def previous_incident(t):
    rows = alerts(t).withColumn("root", F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")))
    return rows.withColumn("previous", F.lag("event_id").over(W.partitionBy("root").orderBy("opened_at", "event_id")))


@tool("week:s user_id:l alerts:l", f"SELECT strftime(opened_at, '%G-W%V') AS week, user_id, count(*) AS alerts FROM ({ALERTS}) GROUP BY ALL")
def alerts_by_week(t):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "opened_at").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("opened_at").cast("string"), 2, "0"))
    return alerts(t).groupBy(week.alias("week"), "user_id").agg(n_rows().alias("alerts"))


# Streaming twins of the load and volume operators.


@tool("event_id:l", "SELECT event_id FROM events")
def stream_dedup_watermark(t):
    from lakeloom.streaming.events import deduplicated

    return deduplicated(t("events"))


@tool("day:t event_type:s n:l", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(t):
    from lakeloom.streaming.events import daily_counts

    return daily_counts(t("events"))

