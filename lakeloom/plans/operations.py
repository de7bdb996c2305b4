"""Queries of incidents, query histories, tables on files and result tables, over the small company of ``platform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import graph, incremental
from lakeloom.operators import incidents as inc
from lakeloom.plans import platform as co
from lakeloom.plans.toolkit import FAILED_SQL, PATHS, edges, failed, n_rows, tool
from lakeloom.session import shared_dir
from lakeloom.sources import artifacts, querylog, tables

# Incidents.

SKIPPED_SQL = "(SELECT concat('order_', o_orderkey) AS node FROM orders WHERE o_orderkey % 7 IN (2, 3))"
#: Every failed node's nearest failed ancestor, and its root, by following those.
UP_SQL = f"(SELECT node, arg_min(ancestor, (depth, ancestor)) AS up FROM ({PATHS}) WHERE ancestor IN {FAILED_SQL} GROUP BY ALL)"
ROOTS_SQL = f"(WITH RECURSIVE u AS MATERIALIZED (SELECT * FROM {UP_SQL} x WHERE node IN {FAILED_SQL}), w AS (SELECT node, node AS root, 0 AS i FROM {FAILED_SQL} f UNION ALL SELECT w.node, u.up, i + 1 FROM w JOIN u ON u.node = w.root) SELECT node, arg_max(root, i) AS root FROM w GROUP BY ALL)"
GROUPS_SQL = f"""WITH r AS MATERIALIZED (SELECT * FROM {ROOTS_SQL} x), tops AS (SELECT DISTINCT root FROM r),
events AS (SELECT node, root FROM r UNION ALL SELECT node, root FROM r WHERE node LIKE 'nation%'),
idle AS (SELECT r.root, list_sort(list(DISTINCT u.node)) AS nodes FROM {UP_SQL} u JOIN r ON r.node = u.up WHERE u.node IN {SKIPPED_SQL} AND u.node NOT IN (SELECT node FROM r) GROUP BY ALL),
above AS (SELECT p.node, p.ancestor FROM ({PATHS}) p WHERE p.ancestor IN (SELECT root FROM tops) AND p.node IN (SELECT node FROM r) AND p.node NOT IN (SELECT root FROM tops)),
twice AS (SELECT ancestor AS root, list_sort(list(DISTINCT node)) AS nodes FROM above WHERE node IN (SELECT node FROM above GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
SELECT g.root, g.n_events, array_to_string(g.nodes, ',') AS failed_nodes, ifnull(array_to_string(idle.nodes, ','), '') AS skipped, ifnull(array_to_string(twice.nodes, ','), '') AS shared
FROM (SELECT root, count(*) AS n_events, list_sort(list(DISTINCT node)) AS nodes FROM events GROUP BY ALL) g LEFT JOIN idle ON idle.root = g.root LEFT JOIN twice ON twice.root = g.root"""


@tool("root:s n_events:l failed_nodes:s skipped:s shared:s", GROUPS_SQL)
def incident_groups(t):
    """Failures of nations (two checks each), customers, suppliers and orders by their root; skipped orders go along."""
    bad = failed(t)
    events = bad.unionAll(bad.where("node LIKE 'nation%'")).select(F.lit("c").alias("check_id"), F.col("node").alias("subject"))
    skipped = t("orders").where("o_orderkey % 7 IN (2, 3)").selectExpr("concat('order_', o_orderkey) AS node")
    out = graph.group_failures(graph.closure(edges(t)), events, skipped)
    return out.withColumns({c: F.array_join(c, ",") for c in ("failed_nodes", "skipped", "shared")})


#: Incidents, one an error event.
INCIDENTS = {
    "incident_id": "concat('INC-', CAST(event_id AS VARCHAR(20)))",
    "severity": "CASE WHEN event_id % 10 = 0 THEN 'SEV1' WHEN event_id % 10 < 4 THEN 'SEV2' ELSE 'SEV3' END",
    "root": "concat('m', CAST(user_id % 10 AS VARCHAR(20)))",
    "owner": "concat('p', CAST(user_id % 7 AS VARCHAR(20)))",
    "opened_at": "ts",
    "resolved_at": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE ts + INTERVAL '1' MINUTE * (event_id % 3000 + 1) END",
}
INCIDENTS_SQL = f"(SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in INCIDENTS.items())} FROM events WHERE event_type = 'error')"


def incidents(t) -> DataFrame:
    return t("events").where("event_type = 'error'").selectExpr("event_id", *[f"{e} AS {c}" for c, e in INCIDENTS.items()])


WINDOWS = [("close", "finance", 3, 2), ("sale", "sales", 0, 31), ("audit", "platform", 0, 0)]
AT = "2024-01-31 12:00:00"
STAGED_SQL = f"""SELECT incident_id, severity AS from_severity, CASE WHEN len(r) >= room THEN 'SEV1' ELSE 'SEV2' END AS to_severity, array_to_string(r[1:room], ';') AS reasons FROM (SELECT incident_id, severity, CASE severity WHEN 'SEV1' THEN 0 WHEN 'SEV2' THEN 1 ELSE 2 END AS room,
list_concat(CASE WHEN epoch_us(TIMESTAMP '{AT}') - epoch_us(opened_at) >= 3600000000 * CASE severity WHEN 'SEV2' THEN 200 WHEN 'SEV3' THEN 500 END THEN [concat('overdue at ', severity)] ELSE [] END, CASE event_id % 3 WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN [] ELSE ['close, 2024-01'] END WHEN 2 THEN ['sale, 2024-01'] ELSE [] END) AS r FROM {INCIDENTS_SQL} WHERE resolved_at IS NULL) WHERE room > 0 AND len(r) > 0"""


@tool("incident_id:s from_severity:s to_severity:s reasons:s", STAGED_SQL)
def incident_escalations(t):
    rows = incidents(t).where("resolved_at IS NULL")
    done = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("close, 2024-01")))
    teams = F.get(F.array(F.lit("platform"), F.lit("finance"), F.lit("sales")), (F.col("event_id") % 3).cast("int"))
    windows = co.rows_of(t, WINDOWS, "name string, team string, last_days int, first_days int")
    state = rows.select("incident_id", "severity", F.col("opened_at").alias("since"), done.alias("done"))
    out = inc.escalations(state, rows.select("incident_id", teams.alias("team")), windows, F.lit(AT).cast("timestamp_ntz"), {"SEV2": 200, "SEV3": 500})
    return out.withColumn("reasons", F.array_join("reasons", ";"))


#: A failing model for every order: every third is a staging model; all read their customer's source, even ones another.
#: One in four has a failing test of two columns that are traced, one in four of a column that is not.
ROUTE = {
    "root": "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'stg_o' ELSE 'o' END, o_orderkey)", "mine": "concat('source.c', o_custkey)", "other": "concat('source.s', o_orderkey % 10)",
    "owner": "CASE WHEN o_orderkey % 6 <> 0 THEN concat('m', o_orderkey % 3) END", "source_owner": "concat('pc', o_custkey % 7)",
}
TO_SOURCE = "(o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0) OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1)"


@tool("root:s dataset:s routed_to:s owner:s naive_owner:s", f"SELECT {ROUTE['root']} AS root, root AS dataset, CASE WHEN {TO_SOURCE} THEN {ROUTE['mine']} ELSE root END AS routed_to, CASE WHEN {TO_SOURCE} THEN {ROUTE['source_owner']} ELSE ifnull({ROUTE['owner']}, 'unowned') END AS owner, ifnull({ROUTE['owner']}, 'unowned') AS naive_owner FROM orders")
def incident_routes(t):
    """To the owner of the one source that all failing columns come from, of a staging model's one source, or its own."""
    rows = t("orders").selectExpr("o_orderkey AS k", *[f"{e} AS {c}" for c, e in ROUTE.items()])
    nodes = rows.selectExpr("root AS unique_id", "'model' AS resource_type", "root AS name", "CASE WHEN k % 2 = 0 THEN array(mine, other) ELSE array(mine) END AS depends_on", "CAST(NULL AS STRING) AS attached_node")
    columns = "CASE k % 4 WHEN 1 THEN array('a', 'b') WHEN 2 THEN array('a', 'untraced') END"
    events = rows.selectExpr("root", "root AS subject", "CASE WHEN k % 4 IN (1, 2) THEN 'test' ELSE 'model' END AS check_type", f"{columns} AS columns")
    traced = rows.selectExpr("root AS unique_id", "explode(array(struct('a' AS c, mine AS s), struct('b' AS c, CASE WHEN k % 5 = 0 THEN other ELSE mine END AS s))) AS x").selectExpr("unique_id", "x.c AS column_name", "x.s AS source")
    owned = rows.where("owner IS NOT NULL").selectExpr("root AS node", "owner").unionAll(rows.selectExpr("mine", "source_owner").distinct()).unionAll(rows.selectExpr("other", "concat('p', other)").distinct())
    return inc.routes(events.select("root"), nodes, owned.withColumn("team", F.lit("x")), events, traced)


RUN_SQL = "(SELECT concat('m', CAST(user_id % 10 AS VARCHAR)) AS node, CASE WHEN event_id % 97 = 5 THEN 'error' WHEN event_id % 50 = 1 THEN 'skipped' ELSE 'success' END AS status FROM events WHERE event_id % 13 = 0)"


def run_results(t) -> DataFrame:
    status = F.when(F.col("event_id") % 97 == 5, "error").when(F.col("event_id") % 50 == 1, "skipped").otherwise("success")
    return t("events").where("event_id % 13 = 0").select(F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("node"), status.alias("status"))


@tool("node:s status:s", f"SELECT node, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'success' END AS status FROM {RUN_SQL} WHERE status <> 'skipped' GROUP BY ALL")
def incident_worst_status(t):
    return inc.worst_status(run_results(t))


#: Orders as incidents' roots, their lines as tests. Every 13th root is a source, every 17th a test itself; lines of
#: return flag A passed, of R failed, of N did not run; an order of status P was not built.
HEALTH = {"incident_id": "o_orderkey", "root": "concat(CASE WHEN o_orderkey % 13 = 0 THEN 'source.' WHEN o_orderkey % 17 = 0 THEN 'test.' ELSE '' END, o_orderkey)", "dataset": "concat('', o_orderkey)"}
STATUS = "CASE WHEN o_orderkey % 13 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'warn' WHEN 'O' THEN 'error' ELSE 'pass' END WHEN o_orderkey % 17 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'pass' ELSE 'fail' END WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'success' WHEN o_orderstatus = 'O' THEN 'error' END"
HEALTH_SQL = f"""SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 13 = 0 THEN o_orderstatus <> 'O' AND tests WHEN o_orderkey % 17 = 0 THEN o_orderstatus = 'F' ELSE (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)) AND tests END AS healthy
FROM (SELECT o.*, coalesce(l.tests, TRUE) AS tests FROM orders o LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag <> 'N') AND NOT bool_or(l_returnflag = 'R') AS tests FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey)"""


@tool("incident_id:l healthy:b", HEALTH_SQL)
def incident_health(t):
    orders = t("orders").selectExpr(*[f"{e} AS {c}" for c, e in HEALTH.items()], f"{STATUS} AS status")
    line = F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = t("lineitem").select(F.col("l_orderkey").cast("string").alias("dataset"), line.alias("node"), "l_returnflag")
    ran = lines.where("l_returnflag <> 'N'").select("node", F.when(F.col("l_returnflag") == "A", "pass").otherwise("fail").alias("status"))
    statuses = orders.where("status IS NOT NULL").select(F.col("root").alias("node"), "status").unionAll(ran)
    return inc.healthy(orders.drop("status"), inc.worst_status(statuses), lines.select("dataset", "node"))


SPREAD = "(0.5 + CAST(CAST(concat('0x', substr(sha256(concat('7:', incident_id, ':{0}')), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"
OPEN_SQL = f"(SELECT i.*, (SELECT count(*) FROM {INCIDENTS_SQL} o WHERE o.owner = i.owner AND (o.opened_at, o.incident_id) < (i.opened_at, i.incident_id) AND (o.resolved_at IS NULL OR o.resolved_at > i.opened_at)) AS owner_open FROM {INCIDENTS_SQL} i)"


@tool("incident_id:s owner_open:l", f"SELECT incident_id, owner_open FROM {OPEN_SQL}")
def incident_load(t):
    return inc.open_by_owner(incidents(t))


@tool("incident_id:s paged:s", f"SELECT incident_id, CASE WHEN event_id % 5 > 0 AND owner_open >= 2 THEN concat('b', CAST(event_id % 5 AS VARCHAR)) ELSE owner END AS paged FROM {OPEN_SQL}")
def incident_paging(t):
    """Who is paged: the owner, or the backup (four in five have one) where the owner has two open incidents already."""
    backup = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")))
    return inc.open_by_owner(incidents(t)).select("incident_id", inc.paged(F.col("owner"), backup, F.col("owner_open"), 2).alias("paged"))


@tool("incident_id:s acknowledged_at:z fixed_at:z", f"SELECT incident_id, opened_at + to_seconds(a) AS acknowledged_at, opened_at + to_seconds(a + f) AS fixed_at FROM (SELECT *, CAST(round_even(CASE severity WHEN 'SEV1' THEN 10.0 WHEN 'SEV2' THEN 30.0 ELSE 120.0 END * (1 + 0.25 * k) * {SPREAD.format('ack')} * 60, 0) AS BIGINT) AS a, CAST(round_even(CASE severity WHEN 'SEV1' THEN 4.0 WHEN 'SEV2' THEN 12.0 ELSE 48.0 END * (1 + 0.25 * k) * {SPREAD.format('resolve')} * 3600, 0) AS BIGINT) AS f FROM (SELECT *, owner_open AS k FROM {OPEN_SQL}))")
def incident_responses(t):
    return inc.responses(inc.open_by_owner(incidents(t)), {"SEV1": 10, "SEV2": 30, "SEV3": 120}, {"SEV1": 4, "SEV2": 12, "SEV3": 48}, 0.25, 7)


FAULTS = [("F1", "s0", "2024-01-02", "2024-01-05", "p1", "sales"), ("F2", "s3", "2024-01-10", None, "p2", "finance"), ("F3", "m5", "2024-01-01", "2024-01-20", "p3", "platform")]
FAULTS_SQL = f"(SELECT fault_id, source_id, CAST(a AS TIMESTAMP) AS injected_at, CAST(b AS TIMESTAMP) AS repaired_at, owner, team FROM {co.literal(FAULTS, 'f(fault_id, source_id, a, b, owner, team)')})"
CAUSED_SQL = f"(SELECT DISTINCT f.fault_id, i.incident_id FROM {FAULTS_SQL} f, {INCIDENTS_SQL} i WHERE (i.root = f.source_id OR EXISTS (SELECT 1 FROM {co.PATHS_SQL} q WHERE q.ancestor = f.source_id AND q.node = i.root)) AND i.opened_at >= injected_at AND i.opened_at <= ifnull(repaired_at, TIMESTAMP '2024-01-25'))"


def faults(t) -> DataFrame:
    rows = co.rows_of(t, FAULTS, "fault_id string, source_id string, a string, b string, owner string, team string")
    return rows.withColumns({"injected_at": F.col("a").cast("timestamp_ntz"), "repaired_at": F.col("b").cast("timestamp_ntz")}).drop("a", "b")


def caused(t) -> DataFrame:
    return inc.caused_by(incidents(t), faults(t), graph.closure(co.links(t)), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@tool("fault_id:s incident_id:s", f"SELECT * FROM {CAUSED_SQL}")
def incident_faults(t):
    return caused(t)


GRADED_SQL = f"(SELECT i.*, f.owner AS fo, f.team AS ft, f.injected_at, (SELECT team FROM {co.MEMBERS_SQL} WHERE person = i.owner) AS team FROM {CAUSED_SQL} c JOIN {INCIDENTS_SQL} i USING (incident_id) JOIN {FAULTS_SQL} f USING (fault_id))"


def share_of(a: str, b: str) -> str:
    return f"(SELECT avg(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} <> {b} THEN 0.0 END) FROM {GRADED_SQL})"


def by_severity(metric: str, value: str, rows: str) -> str:
    return f"SELECT '{metric}', ifnull(severity, 'all'), round(avg({value}), 2) FROM {rows} GROUP BY ROLLUP (severity) HAVING count(*) > 0"


METRICS_SQL = " UNION ALL ".join(
    [
        f"SELECT 'raw_alerts' AS metric, 'all' AS dimension, CAST(count(*) AS DOUBLE) AS value FROM {INCIDENTS_SQL}",
        f"SELECT 'incidents', 'all', count(*) FROM {INCIDENTS_SQL}",
        f"SELECT 'pages', 'all', count(*) FROM {INCIDENTS_SQL} WHERE event_id % 3 = 0",
        f"SELECT 'unmatched_incidents', 'all', count(*) FROM {INCIDENTS_SQL} WHERE incident_id NOT IN (SELECT incident_id FROM {CAUSED_SQL})",
        f"SELECT 'routing_accuracy', 'person', {share_of('owner', 'fo')}",
        f"SELECT 'routing_accuracy', 'team', {share_of('team', 'ft')}",
        f"SELECT 'routing_accuracy_naive', 'person', {share_of(chr(39) + 'p2' + chr(39), 'fo')}",
        f"SELECT 'routing_accuracy_naive', 'team', {share_of(chr(39) + 'sales' + chr(39), 'ft')}",
        by_severity("mttd_hours", "(epoch_us(opened_at) - epoch_us(injected_at)) / 3600000000.0", GRADED_SQL),
        by_severity("mttr_hours", "(epoch_us(resolved_at) - epoch_us(opened_at)) / 3600000000.0", f"(SELECT * FROM {INCIDENTS_SQL} WHERE resolved_at IS NOT NULL)"),
        f"SELECT 'alerts_per_week_before', owner, round(count(*) / (30 / 7.0), 2) FROM {INCIDENTS_SQL} GROUP BY owner",
        f"SELECT 'alerts_per_week_after', owner, round(count(*) FILTER (WHERE event_id % 3 = 0) / (30 / 7.0), 2) FROM {INCIDENTS_SQL} GROUP BY owner",
    ]
)


@tool("metric:s dimension:s value:d", METRICS_SQL)
def incident_metrics(t):
    rows = incidents(t).join(co.members(t).withColumnRenamed("person", "owner"), "owner", "left").withColumns({"naive_owner": F.lit("p2"), "naive_team": F.lit("sales")})
    alerts, pages = incidents(t).select("owner"), incidents(t).where("event_id % 3 = 0").select(F.col("owner").alias("recipient"))
    return inc.metrics(rows, faults(t), caused(t), alerts, pages, 30)


@tool("node:s", f"SELECT node FROM ({PATHS}) WHERE ancestor IN ('nation_3', 'supplier_4') UNION SELECT unnest(['nation_3', 'supplier_4'])")
def incident_rerun(t):
    return inc.rerun_selection(graph.closure(edges(t)), co.rows_of(t, [("nation_3",), ("supplier_4",)], "node string"))


@tool("run_id:l invocations:l checks_run:l failing:l skipped:l incidents:l", "SELECT day(ts) AS run_id, count(*) AS invocations, sum(event_id % 5) AS checks_run, count(*) FILTER (WHERE event_type = 'error') AS failing, count(*) FILTER (WHERE event_type = 'click') AS skipped, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS incidents FROM events GROUP BY ALL")
def incident_runs(t):
    rows = t("events").withColumns({"run_id": F.dayofmonth("ts").cast("long"), "detected_at": F.col("ts"), "checks_run": F.col("event_id") % 5, "incident_id": F.col("user_id")})
    return inc.run_records(rows.where("event_type = 'error'"), rows.where("event_type = 'click'"), rows, rows.where("event_type = 'error'")).drop("detected_at")


@tool("invocation_id:l event_id:l", "SELECT event_id % 100 AS invocation_id, event_id FROM events WHERE event_id % 100 >= 40")
def incident_new_invocations(t):
    arrived = t("events").select((F.col("event_id") % 100).alias("invocation_id"), "event_id")
    return inc.new_invocations(arrived.unionAll(arrived), arrived.where("invocation_id < 40").select("invocation_id"))


# Query histories.

COMMENTED = "concat('SELECT ''x ', CAST(event_id AS VARCHAR(20)), ''', ', CAST(user_id AS VARCHAR(20)), '.5 FROM a1_2f3e4d5c_0000_1111_2222_333344445555 /* {\"unique_id\": \"m', CAST(user_id % 3 AS VARCHAR(20)), '\", \"n\": 7} */ WHERE b2 > 3')"
PLAIN = "concat('SELECT ?, ? FROM a1 /* {\"unique_id\": \"m', CAST(user_id % 3 AS VARCHAR), '\", \"n\": 7} */ WHERE b2 > ?')"


@tool("event_id:l sql_text:s node_id:s", f"SELECT event_id, replace({PLAIN}, ' a1 ', ' a1_2f3e4d5c_0000_1111_2222_333344445555 ') AS sql_text, concat('m', CAST(user_id % 3 AS VARCHAR)) AS node_id FROM events")
def querylog_redact(t):
    rows = t("events").selectExpr("event_id", f"{COMMENTED} AS q")
    return rows.select("event_id", querylog.redacted(F.col("q")).alias("sql_text"), querylog.node_of(F.col("q")).alias("node_id"))


def engine_log(t) -> DataFrame:
    kinds = F.get(F.array(*[F.lit(k) for k in ("dbt", "adhoc", "ingestion")]), (F.col("event_id") % 3).cast("int"))
    tag = querylog.tag(run=F.when(F.col("event_id") % 4 == 3, "other").otherwise("r1"), sim=F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"), actor=kinds, subject=F.when(kinds == "ingestion", F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string"))), person=F.when(kinds == "adhoc", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))))
    read = F.when(F.col("event_id") % 10 == 0, F.array(F.lit("system.parts"))).otherwise(F.array(F.lit("system.one"), F.lit("db.b"), F.lit("db.a")))
    return t("events").selectExpr("*", f"{COMMENTED} AS query").select(
        F.lit("QueryFinish").alias("type"), tag.alias("log_comment"), F.when(F.col("event_id") % 9 == 0, "Show").otherwise("Select").alias("query_kind"), "query",
        F.col("event_id").alias("read_bytes"), F.col("user_id").alias("read_rows"), F.lit(0).alias("written_rows"), read.alias("tables"),
    )


ENGINE_SQL = f"(SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS sim, CASE event_id % 3 WHEN 0 THEN 'dbt' WHEN 1 THEN 'adhoc' ELSE 'ingestion' END AS actor_type, CASE WHEN event_id % 3 = 2 THEN concat('s', CAST(user_id % 2 AS VARCHAR)) ELSE '' END AS subject, CASE WHEN event_id % 3 = 1 THEN concat('p', CAST(user_id % 3 AS VARCHAR)) ELSE '' END AS person, {PLAIN} AS sql_text, event_id AS rb, user_id, event_id FROM events WHERE event_id % 4 <> 3)"


@tool("query_id:s actor:s actor_type:s node_id:s started_at:z sql_text:s bytes_scanned:l tables:s", f"SELECT concat(sim, '/', actor_type, '/', lpad(CAST(row_number() OVER (PARTITION BY sim, actor_type ORDER BY subject, person, sql_text, rb) - 1 AS VARCHAR), 6, '0')) AS query_id, CASE actor_type WHEN 'adhoc' THEN person WHEN 'dbt' THEN 'dbt' ELSE 'loader' END AS actor, actor_type, CASE actor_type WHEN 'dbt' THEN concat('m', CAST(user_id % 3 AS VARCHAR)) WHEN 'ingestion' THEN subject END AS node_id, CAST(sim AS TIMESTAMP) AS started_at, sql_text, rb AS bytes_scanned, 'db.a,db.b' AS tables FROM {ENGINE_SQL} WHERE event_id % 9 <> 0 AND event_id % 10 <> 0")
def querylog_records(t):
    return querylog.EngineLog(engine_log(t), "r1").records().withColumn("tables", F.array_join("tables", ","))


@tool("reason:s n:l", f"SELECT CASE WHEN event_id % 9 = 0 THEN 'not billed' ELSE 'system tables only' END AS reason, count(*) AS n FROM {ENGINE_SQL} WHERE event_id % 9 = 0 OR event_id % 10 = 0 GROUP BY ALL")
def querylog_skipped(t):
    return querylog.EngineLog(engine_log(t), "r1").skipped()


def jobs(t) -> DataFrame:
    """A vendor's job history as it is read from JSON."""
    k = F.col("event_id") % 20
    lines = t("events").select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("job_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creation_time"), F.when(k != 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("start_time"),
        F.date_format(F.expr("ts + INTERVAL '90' SECOND"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_time"), F.lit("p").alias("project_id"), F.concat(F.lit("User"), (F.col("user_id") % 4).cast("string"), F.lit("@Shop.com")).alias("user_email"),
        F.when(k == 0, "LOAD").otherwise("QUERY").alias("job_type"), F.when(k == 1, "SCRIPT").otherwise("SELECT").alias("statement_type"), F.lit("SELECT 1").alias("query"), F.when(k == 2, "RUNNING").otherwise("DONE").alias("state"),
        F.col("event_id").alias("total_bytes_billed"), (k == 3).alias("cache_hit"), F.array().cast("array<struct<project_id: string, dataset_id: string, table_id: string>>").alias("referenced_tables"),
        F.when(k == 5, F.array(F.struct(F.lit("dashboard").alias("key"), F.lit("sales").alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>")).alias("labels"),
        F.when(k == 6, F.struct(F.lit("quota").alias("reason"))).alias("error_result"),
    )).alias("j"))
    return lines.select(F.from_json("j", querylog.BIGQUERY_JOBS).alias("r")).select("r.*")


@tool("query_id:s actor:s actor_type:s node_id:s started_at:z wallclock_ms:d bytes_scanned:l", "SELECT concat('bigquery:', CAST(event_id AS VARCHAR)) AS query_id, CASE user_id % 4 WHEN 3 THEN 'robot' ELSE concat('user', CAST(user_id % 4 AS VARCHAR)) END AS actor, CASE user_id % 4 WHEN 3 THEN 'dbt' ELSE 'adhoc' END AS actor_type, CASE WHEN event_id % 20 = 5 THEN 'exposure.company.sales' END AS node_id, date_trunc('second', ts) AS started_at, CASE WHEN event_id % 20 <> 4 THEN 90000.0 END AS wallclock_ms, event_id AS bytes_scanned FROM events WHERE event_id % 20 NOT IN (0, 1, 2, 3, 6)")
def vendor_bigquery(t):
    return querylog.BigQueryJobs(jobs(t), {"User3@Shop.com": "dbt"}, {"User3@Shop.com": "robot"}).records()


@tool("reason:s n:l", "SELECT CASE event_id % 20 WHEN 0 THEN 'not a query' WHEN 1 THEN 'script parent' WHEN 2 THEN 'not finished' WHEN 3 THEN 'served from cache' ELSE 'failed' END AS reason, count(*) AS n FROM events WHERE event_id % 20 IN (0, 1, 2, 3, 6) GROUP BY ALL")
def vendor_bigquery_skipped(t):
    return querylog.BigQueryJobs(jobs(t)).skipped()


def statements_run(t) -> DataFrame:
    tag = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.lit("inv").alias("dbt_invocation_id"), F.lit("ops").alias("dashboard")))).otherwise("")
    return t("events").select(
        F.col("event_id").cast("string").alias("QUERY_ID"), F.lit("SELECT 1").alias("QUERY_TEXT"), F.concat(F.lit("USER"), (F.col("user_id") % 3).cast("string")).alias("USER_NAME"), tag.alias("QUERY_TAG"),
        F.when(F.col("event_id") % 6 == 0, "FAIL").when(F.col("event_id") % 6 == 1, "Incident").otherwise("SUCCESS").alias("EXECUTION_STATUS"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("START_TIME"),
        F.col("user_id").alias("TOTAL_ELAPSED_TIME"), F.col("event_id").alias("BYTES_SCANNED"),
    )


@tool("query_id:s run_id:s actor:s node_id:s started_at:z wallclock_ms:d", "SELECT concat('snowflake:', CAST(event_id AS VARCHAR)) AS query_id, CASE WHEN event_id % 5 = 0 THEN 'inv' ELSE CAST(event_id AS VARCHAR) END AS run_id, concat('user', CAST(user_id % 3 AS VARCHAR)) AS actor, CASE WHEN event_id % 5 = 0 THEN 'exposure.company.ops' END AS node_id, date_trunc('second', ts) AS started_at, CAST(user_id AS DOUBLE) AS wallclock_ms FROM events WHERE event_id % 6 > 1")
def vendor_snowflake(t):
    return querylog.SnowflakeHistory(statements_run(t)).records()


@tool("reason:s n:l", "SELECT CASE event_id % 6 WHEN 0 THEN 'status fail' ELSE 'status incident' END AS reason, count(*) AS n FROM events WHERE event_id % 6 < 2 GROUP BY ALL")
def vendor_snowflake_skipped(t):
    return querylog.SnowflakeHistory(statements_run(t)).skipped()


# Tables on files.


def place(t, name: str) -> str:
    import uuid

    return f"{shared_dir(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@tool("o_orderkey:l o_totalprice:d", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def table_create_as(t):
    return tables.create_as(t("orders").where("o_totalprice > 1000").select("o_orderkey", "o_totalprice"), place(t, "created"), ["o_orderkey"], by_range=True)


@tool("n_rows:l last_key:l cents:l", "SELECT count(*) AS n_rows, max(o_orderkey) AS last_key, CAST(sum(CAST(o_totalprice * 100 AS DECIMAL(18,0))) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'F'")
def table_discard(t):
    """What is seen of orders that are computed and thrown away."""
    cents = F.sum((F.col("o_totalprice").cast("decimal(12,2)") * 100).cast("long"))
    found = tables.discard(t("orders").where("o_orderstatus <> 'F'"), n_rows=F.count(F.lit(1)), last_key=F.max("o_orderkey"), cents=cents)
    return co.rows_of(t, [(found["n_rows"], found["last_key"], found["cents"])], "n_rows long, last_key long, cents long")


@tool("c_custkey:l c_name:s", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def table_create_view(t):
    return tables.create_view(t("customer").where("c_acctbal < 0").select("c_custkey", "c_name"), "poor_customers")


@tool("user_id:l event_id:l", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY ALL")
def table_append_compact(t):
    """Two appends, then one row a key is left."""
    spark, path, rows = t("region").sparkSession, place(t, "versions"), t("events").select("user_id", "event_id")
    for k in (0, 1):
        tables.append_versions(rows.where(F.col("event_id") % 2 == k), path, F.lit(k), "user_id")
    tables.compact(spark, path, lambda x: x.groupBy("user_id").agg(F.max("event_id").alias("event_id")))
    return spark.read.parquet(path)


@tool("o_orderkey:l status:s", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 50 = 1")
def table_mutate(t):
    """Update, delete and rename in place (the table is read while it is replaced), and rows upserted."""
    spark, path = t("region").sparkSession, place(t, "mutated")
    tables.replace(t("orders").select("o_orderkey", "o_orderstatus", "o_custkey"), path)
    rows = tables.updated(spark.read.parquet(path), F.col("o_orderkey") % 3 == 0, o_orderstatus=F.lit("new"))
    tables.replace(tables.renamed(tables.deleted(rows, F.col("o_orderkey") % 5 == 0), "o_orderstatus", "status"), path)
    tables.replace(tables.dropped(spark.read.parquet(path), "o_custkey"), path)
    fresh = t("orders").where("o_orderkey % 50 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("added").alias("status"))
    tables.replace(incremental.upsert(spark.read.parquet(path), fresh, "o_orderkey"), path)
    return spark.read.parquet(path)


@tool("c_custkey:l c_name:s c_acctbal:d", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'late' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def table_upsert(t):
    old = t("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal")
    new = t("customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("late").alias("c_name"), "c_acctbal")
    return incremental.upsert(old, new, "c_custkey")


@tool("c_custkey:l c_name:s", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'late' END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def table_insert_or_ignore(t):
    old = t("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    new = t("customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("late").alias("c_name"))
    return incremental.insert_or_ignore(old, new.unionAll(new), "c_custkey")


@tool("o_orderkey:l note:s noted_at:z", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('a \"b\", ', o_orderstatus) END AS note, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS noted_at FROM orders")
def table_csv_load(t):
    """Null and the empty string stay apart through a bulk load."""
    path = place(t, "csv")
    note = F.when(F.col("o_orderkey") % 3 == 1, "").when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit('a "b", '), "o_orderstatus"))
    rows = t("orders").select("o_orderkey", note.alias("note"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("timestamp")).alias("noted_at"))
    tables.dump_csv(rows, path)
    return tables.load_csv(t("region").sparkSession, path, "o_orderkey long, note string, noted_at timestamp")


@tool("n_name:s n_nationkey:l", "SELECT n_name, n_nationkey FROM nation")
def table_seed(t):
    path = place(t, "seed")
    t("nation").select("n_name", "n_nationkey").coalesce(1).write.option("header", True).csv(path)
    return tables.seed(t("region").sparkSession, path, "n_name string, n_nationkey int")


@tool("o_orderkey:l changed_at:z", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN o_orderdate + INTERVAL 1 HOUR ELSE o_orderdate END AS changed_at FROM orders")
def table_rebuild_months(t):
    """A full build by month, then one that replaces the newest two months only."""
    spark, path = t("region").sparkSession, place(t, "months")
    rows = t("orders").select("o_orderkey", F.col("o_orderdate").alias("changed_at"))
    incremental.write_months(rows, path, "changed_at")
    later = rows.withColumn("changed_at", F.when(F.col("changed_at") >= F.lit("2001-07-01").cast("timestamp_ntz"), F.expr("changed_at + INTERVAL '1' HOUR")).otherwise(F.col("changed_at")))
    newest = F.broadcast(later.agg(F.max("changed_at").alias("_newest")))  # one row
    incremental.write_months(incremental.recent_months(later.crossJoin(newest), "changed_at", F.col("_newest")).drop("_newest"), path, "changed_at")
    return spark.read.parquet(path).select("o_orderkey", "changed_at")


@tool("report:s n:l", "SELECT 'late' AS report, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'")
def table_freeze_reports(t):
    spark, orders = t("region").sparkSession, t("orders")
    reports = {"late": orders.where("o_orderdate >= '2000-01-01'").agg(n_rows().alias("n")), "open": orders.where("o_orderstatus = 'O'").agg(n_rows().alias("n"))}
    paths = tables.frozen(reports, place(t, "frozen"))
    return spark.read.parquet(paths["late"]).select(F.lit("late").alias("report"), "n").unionAll(spark.read.parquet(paths["open"]).select(F.lit("open").alias("report"), "n"))


@tool("o_orderkey:l o_orderdate:z", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-02-01'")
def scan_changed_range(t):
    return tables.changed_range(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1998-01-01 00:00:00", "1998-02-01 00:00:00")


HASH = "CAST(concat('0x', substr(md5(concat('42:', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT)"


@tool("o_orderkey:l", f"SELECT o_orderkey FROM orders WHERE {HASH} % 10 = 0")
def sample_modulo_hash(t):
    return t("orders").where(tables.hashed(42, "o_orderkey") % 10 == 0).select("o_orderkey")


@tool("o_orderkey:l", f"SELECT o_orderkey FROM orders ORDER BY {HASH}, o_orderkey LIMIT 100")
def sample_by_hash(t):
    return tables.sample_by_hash(t("orders").select("o_orderkey"), 42, "o_orderkey", n=100)


@tool("o_orderkey:l", "SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 99")
def filter_page_loss(t):
    return t("orders").where("o_orderkey % 100 <> 99").select("o_orderkey")


@tool("event_id:l", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 3")
def filter_json_field(t):
    return t("events").where(F.get_json_object("props", "$.k").cast("long") == 3).select("event_id")


@tool("p_partkey:l", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' OR p_name LIKE '%e' OR p_brand LIKE '%#3%'")
def filter_like(t):
    return t("part").where(F.col("p_type").startswith("S") | F.col("p_name").endswith("e") | F.col("p_brand").like("%#3%")).select("p_partkey")


@tool("o_orderkey:l", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 55]))")
def filter_in_array(t):
    keys = co.rows_of(t, [([1, 2, 3, 5, 8, 13, 21, 34, 55],)], "k array<long>").select(F.explode("k").alias("o_orderkey"))
    return t("orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey")


@tool("user_id:l event_id:l number:l", "SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) + 999 AS number FROM events")
def window_mint_keys(t):
    return tables.minted(t("events").select("user_id", "event_id"), "number", "user_id", "event_id", start=1000)


@tool("c_custkey:l c_name:s twin:s", "SELECT a.c_custkey, a.c_name, b.c_name AS twin FROM customer a JOIN customer b ON b.c_custkey = 1 + (a.c_custkey * 31) % 100 WHERE a.c_custkey % 7 = 0")
def join_self_lookup(t):
    base = t("customer").select(F.col("c_custkey").alias("_k"), F.col("c_name").alias("twin"))
    return t("customer").where("c_custkey % 7 = 0").withColumn("_k", 1 + F.col("c_custkey") * 31 % 100).join(base, "_k").select("c_custkey", "c_name", "twin")


@tool("event_type:s before:l after:l", "SELECT event_type, count(*) FILTER (WHERE day(ts) < 3) AS before, count(*) FILTER (WHERE day(ts) > 28) AS after FROM events WHERE day(ts) < 3 OR day(ts) > 28 GROUP BY ALL")
def join_outer_merge(t):
    n = lambda rows, name: rows.groupBy("event_type").agg(n_rows().alias(name))
    both = n(t("events").where("day(ts) < 3"), "before").join(n(t("events").where("day(ts) > 28"), "after"), "event_type", "full")
    return both.na.fill(0, ["before", "after"])


@tool("event_type:s k:l n:l", "SELECT event_type, event_id % 3 AS k, count(*) AS n FROM events GROUP BY ALL")
def agg_counter_by_key(t):
    return t("events").groupBy("event_type", (F.col("event_id") % 3).alias("k")).agg(n_rows().alias("n"))


ROW = "md5(concat_ws('|', CAST(n_name AS VARCHAR), CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR)))"


@tool("n_rows:l h1:l h2:l", f"SELECT count(*) AS n_rows, sum(CAST(concat('0x', substr({ROW}, 1, 8)) AS BIGINT)) AS h1, sum(CAST(concat('0x', substr({ROW}, 9, 8)) AS BIGINT)) AS h2 FROM nation")
def agg_fingerprint(t):
    return tables.fingerprint(t("nation"))


@tool("code:s title:s login:s message:s", "SELECT concat('C', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS code, concat(upper(substr(replace(lower(c_mktsegment), '_', ' '), 1, 1)), substr(replace(lower(c_mktsegment), '_', ' '), 2)) AS title, lower(c_name) AS login, concat('a ', c_name, ' b') AS message FROM customer")
def str_forms(t):
    x = F.replace(F.lower("c_mktsegment"), F.lit("_"), F.lit(" "))
    title = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
    code = F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    message = artifacts.tidy(F.concat(F.lit("  a \n\t"), "c_name", F.lit("   b ")))
    return t("customer").select(code.alias("code"), title.alias("title"), querylog.login(F.concat("c_name", F.lit("@Shop.com"))).alias("login"), message.alias("message"))


@tool("event_id:l tag:s who:s", "SELECT event_id, concat('{\"run\":\"r\",\"n\":', CAST(event_id % 7 AS VARCHAR), '}') AS tag, CASE event_type WHEN 'error' THEN 'ops' WHEN 'click' THEN 'web' ELSE event_type END AS who FROM events")
def json_tag_and_map(t):
    tag = querylog.tag(run=F.lit("r"), none=F.lit(None).cast("string"), n=F.col("event_id") % 7)
    return t("events").select("event_id", tag.alias("tag"), querylog.labelled(F.col("event_type"), {"error": "ops", "click": "web"}, F.col("event_type")).alias("who"))


@tool("o_orderkey:l pick:s near_end:b", f"SELECT o_orderkey, (['a', 'b', 'c'])[1 + {HASH} % 3] AS pick, day(o_orderdate) <= 2 OR day(o_orderdate) > day(last_day(o_orderdate)) - 3 AS near_end FROM orders")
def pick_and_window(t):
    pick = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (1 + tables.hashed(42, "o_orderkey") % 3).cast("int"))
    return t("orders").select("o_orderkey", pick.alias("pick"), inc.window_open(F.to_date("o_orderdate"), F.lit(3), F.lit(2)).alias("near_end"))


@tool("table_name:s column_name:s ordinal:l type:s", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'string'), ('nation', 'n_regionkey', 3, 'int'), ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'string')) v(table_name, column_name, ordinal, type)")
def catalogue_columns(t):
    return artifacts.catalogue_columns({x: t(x) for x in ("nation", "region")}).drop("scale")


@tool("table_name:s files:l rows:l", "SELECT 'orders' AS table_name, 1 AS files, count(*) AS rows FROM orders")
def catalogue_storage(t):
    return artifacts.storage("orders", t("orders")).drop("bytes")


@tool("now:z", "SELECT max(ts) AS now FROM events")
def load_clock(t):
    return tables.clock(t("events").select(F.col("ts").alias("loaded_until")))


@tool("event_id:l user_id:l value:d", "SELECT event_id, user_id, NULL AS value FROM events WHERE event_type = 'click'")
def load_nulled(t):
    return tables.nulled(t("events").where("event_type = 'click'").select("event_id", "user_id", "value"), "value")


@tool("event_id:l", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20'")
def load_backfill(t):
    spark, path = t("region").sparkSession, place(t, "backfill")
    tables.replace(t("events").limit(5), path)  # an old copy, which goes
    tables.backfill(t("events"), path, "2024-01-20 00:00:00", "ts", "event_id")
    return spark.read.parquet(path).select("event_id")
