"""Queries of the platform's own operators: cost, ownership, incidents, reconciliation, tables on files.

The query log, dashboard views and runs are derived from the ``events`` table by expressions that Spark and DuckDB read
alike; the small registries are literal rows. Each operator's SQL is written apart from its plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import attribution as att
from lakeloom.operators import cost, graph
from lakeloom.plans.toolkit import EDGE_SQL, edges, n_rows, tool

# The company in small.

#: unique_id, resource_type, relation, attached_node, materialized
NODES = (
    [(f"m{i}", "model", f"db.m{i}", None, "view" if i == 9 else "incremental" if i == 4 else "table") for i in range(10)]
    + [(f"t{i}", "test", None, f"m{i}" if i < 4 else None, None) for i in range(5)]
    + [(f"s{i}", "source", f"raw.s{i}", None, None) for i in range(4)]
    + [(f"e{i}", "exposure", None, None, None) for i in range(3)]
)
LINKS = [tuple(x.split(">")) for x in "s0>m0 s1>m1 s2>m2 s3>m3 m0>m4 m1>m4 m2>m5 m4>m6 m5>m6 m3>m7 m6>m8 m7>m9 m8>e0 m9>e1 m6>e2".split()]
RULES = [("m*", "eve", "finance", "fay"), ("m[0-3]", "cat", "sales", "dan"), ("s*", "ann", "platform", None), ("s3", "zed", "platform", None), ("e0", "dan", "sales", "dan"), ("e[!0]", "gus", "nowhere", None), ("x?", "eve", "finance", None)]
MEMBERS = [("ann", "platform"), ("bob", "platform"), ("cat", "sales"), ("dan", "sales"), ("eve", "finance"), ("fay", "finance"), *((f"p{i}", ("platform", "sales", "finance")[i % 3]) for i in range(6))]
TIERS = {"m6": 8, "m8": 20, "m9": 4, "e0": 30, "e1": 10, "e2": 40}


def literal(rows: Iterable[tuple], name: str) -> str:
    """Rows as SQL."""
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) {name}"


NODES_SQL = literal(NODES, "n(unique_id, resource_type, relation, attached_node, materialized)")
LINKS_SQL = literal(LINKS, "l(parent_id, child_id)")
MEMBERS_SQL = literal(MEMBERS, "p(person, team)")
#: What the rules come to: unique_id, team, owner. (``m*`` and ``m[0-3]`` are equally specific; the first pattern counts.)
OWNERS = [*((f"m{i}", "finance", "eve") for i in range(10)), *((f"s{i}", "platform", "zed" if i == 3 else "ann") for i in range(4)), ("e0", "sales", "dan"), ("e1", "nowhere", "gus"), ("e2", "nowhere", "gus")]
OWNERS_SQL = literal(OWNERS, "o(unique_id, team, owner)")
PATHS_SQL = f"(WITH RECURSIVE w AS (SELECT parent_id AS ancestor, child_id AS node, 1 AS depth FROM {LINKS_SQL} UNION SELECT w.ancestor, l.child_id, depth + 1 FROM w JOIN {LINKS_SQL} ON l.parent_id = w.node) SELECT ancestor, node, min(depth) AS depth FROM w GROUP BY ALL)"


def rows_of(t, rows: Iterable[tuple], schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame([*rows], schema)


def nodes(t) -> DataFrame:
    return rows_of(t, NODES, "unique_id string, resource_type string, relation string, attached_node string, materialized string").withColumn("name", F.col("unique_id"))


def links(t) -> DataFrame:
    return rows_of(t, LINKS, "parent_id string, child_id string")


def members(t) -> DataFrame:
    return rows_of(t, MEMBERS, "person string, team string")


def rules(t) -> DataFrame:
    return rows_of(t, RULES, "match string, owner string, team string, backup string")


def owners(t) -> DataFrame:
    return graph.resolve(nodes(t).select(F.col("unique_id").alias("node")), rules(t)).select(F.col("node").alias("unique_id"), "team", "owner")


#: The query log, column by column, in both dialects.
LOG = {
    "event_id": "event_id",
    "query_id": "concat('q', CAST(event_id AS VARCHAR(20)))",
    "actor_type": "CASE event_id % 7 WHEN 0 THEN 'dbt' WHEN 1 THEN 'dbt' WHEN 2 THEN 'ingestion' WHEN 3 THEN 'reconcile' WHEN 4 THEN 'dashboard' WHEN 5 THEN 'adhoc' ELSE 'maintenance' END",
    "actor": "concat('p', CAST(user_id % 7 AS VARCHAR(20)))",
    "node_id": "CASE event_id % 7 WHEN 0 THEN CASE WHEN user_id % 11 = 10 THEN NULL ELSE concat('m', CAST(user_id % 11 AS VARCHAR(20))) END WHEN 1 THEN concat('t', CAST(user_id % 5 AS VARCHAR(20))) WHEN 2 THEN concat('s', CAST(user_id % 5 AS VARCHAR(20))) WHEN 4 THEN concat('e', CAST(user_id % 3 AS VARCHAR(20))) WHEN 6 THEN concat('s', CAST(user_id % 4 AS VARCHAR(20))) ELSE NULL END",
    "started_at": "ts + INTERVAL '1' DAY * ((event_id % 3) * 31)",
    "bytes_scanned": "(event_id % 1000) * 1000003",
    "rows_scanned": "event_id % 100",
    "query_kind": "CASE WHEN event_id % 7 = 0 AND user_id % 11 <> 6 THEN 'Insert' ELSE 'Select' END",
    "t1": "CASE WHEN event_id % 7 IN (4, 5) THEN concat('db.m', CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE user_id % 4 END AS VARCHAR(20))) ELSE NULL END",
    "t2": "CASE WHEN event_id % 14 = 4 THEN 'raw.s0' ELSE NULL END",
}
LOG_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in LOG.items())} FROM events)"
VIEWS_SQL = "(SELECT ts + INTERVAL '1' DAY * ((event_id % 3) * 31) AS viewed_at, concat('e', CAST(event_id % 4 AS VARCHAR(20))) AS exposure, concat('p', CAST(user_id % 7 AS VARCHAR(20))) AS person FROM events WHERE event_type = 'view')"


def log(t) -> DataFrame:
    rows = t("events").selectExpr(*[f"{e} AS {c}" for c, e in LOG.items()])
    return rows.withColumn("tables", F.array_compact(F.array("t1", "t2")))


def views(t) -> DataFrame:
    rows = t("events").where("event_type = 'view'")
    return rows.selectExpr("ts + INTERVAL '1' DAY * ((event_id % 3) * 31) AS viewed_at", "concat('e', CAST(event_id % 4 AS VARCHAR(20))) AS exposure", "concat('p', CAST(user_id % 7 AS VARCHAR(20))) AS person")


def attributed(t) -> DataFrame:
    return att.attribute(log(t), nodes(t), owners(t), members(t), "ann")


# Pools and shares.

SPLIT = """SELECT {out}, CAST((u + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY w DESC, {key}) = 1 THEN pool - sum(u) OVER (PARTITION BY {by}) ELSE 0 END) AS DOUBLE) / 1e12 AS usd
FROM (SELECT *, f + CASE WHEN {up} THEN 1 ELSE 0 END AS u FROM (SELECT *, (pool * w) // s AS f, (pool * w) % s AS r FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY {by}) AS HUGEINT) AS s FROM ({rows}) WHERE w > 0)))"""
HALF_EVEN = "2 * r > s OR (2 * r = s AND f % 2 = 1)"


def pool_of(t, usd: str) -> DataFrame:
    months = log(t).select(att.month("started_at").alias("month")).distinct()
    return months.withColumn("usd", F.lit(usd).cast("decimal(25,12)"))


@tool("query_id:s month:s usd:d", SPLIT.format(out="query_id, month", by="month", key="query_id", up=HALF_EVEN, rows=f"SELECT query_id, strftime(started_at, '%Y-%m') AS month, CAST(bytes_scanned AS HUGEINT) AS w, 100000000000001::HUGEINT AS pool FROM {LOG_SQL}"))
def cost_compute_shares(t):
    return att.compute_shares(log(t), pool_of(t, "100.000000000001"))


@tool("month:s table_name:s usd:d", SPLIT.format(out="month, table_name", by="month", key="table_name", up=HALF_EVEN, rows="SELECT concat('2024-0', p_size % 3 + 1) AS month, p_brand AS table_name, CAST(sum(p_size) AS HUGEINT) AS w, 50000000000001::HUGEINT AS pool FROM part GROUP BY ALL"))
def cost_storage_shares(t):
    sizes = t("part").groupBy(F.concat(F.lit("2024-0"), (F.col("p_size") % 3 + 1).cast("string")).alias("month"), F.col("p_brand").alias("table_name")).agg(F.sum("p_size").alias("bytes"))
    pools = rows_of(t, [(f"2024-0{i}", "50.000000000001") for i in (1, 2, 3)], "month string, usd string")
    return att.storage_shares(sizes, pools)


@tool("query_id:s modeled_ms:l table_bytes:s", f"SELECT query_id, 50 + bytes_scanned * 1000 // 200000000 AS modeled_ms, CASE WHEN t2 IS NULL OR t1 IS NULL THEN CAST(bytes_scanned AS VARCHAR) ELSE concat(bytes_scanned // 2 + bytes_scanned % 2, ',', bytes_scanned // 2) END AS table_bytes FROM {LOG_SQL}")
def cost_estimated(t):
    return att.estimated(log(t)).withColumn("table_bytes", F.array_join(F.transform("table_bytes", lambda x: x.cast("string")), ","))


# Attribution.

ATTRIBUTED_SQL = f"""(SELECT query_id, CASE WHEN actor_type = 'reconcile' THEN 'migration' WHEN actor_type IN ('dashboard', 'adhoc') THEN 'consumption' ELSE 'production' END AS cost_kind,
CASE WHEN actor_type = 'reconcile' OR (actor_type = 'dbt' AND subject IS NULL) THEN 'platform' WHEN actor_type = 'adhoc' THEN ifnull((SELECT team FROM {MEMBERS_SQL} WHERE person = actor), 'unattributed') ELSE ifnull((SELECT team FROM {OWNERS_SQL} WHERE unique_id = subject), 'unattributed') END AS team,
CASE WHEN actor_type = 'reconcile' OR (actor_type = 'dbt' AND subject IS NULL) THEN 'ann' WHEN actor_type = 'adhoc' THEN actor ELSE ifnull((SELECT owner FROM {OWNERS_SQL} WHERE unique_id = subject), 'unattributed') END AS owner, subject
FROM (SELECT *, CASE WHEN actor_type = 'adhoc' THEN NULL WHEN actor_type = 'dbt' AND node_id LIKE 't%' THEN (SELECT attached_node FROM {NODES_SQL} WHERE unique_id = node_id) ELSE node_id END AS subject FROM {LOG_SQL}))"""


@tool("query_id:s cost_kind:s team:s owner:s subject:s", f"SELECT * FROM {ATTRIBUTED_SQL}")
def cost_attribution(t):
    return attributed(t)


WEIGHTS_SQL = f"(SELECT l.query_id, p.team, count(*) AS views FROM {LOG_SQL} l JOIN {VIEWS_SQL} v ON v.exposure = l.node_id AND date_trunc('month', v.viewed_at) = date_trunc('month', l.started_at) JOIN {MEMBERS_SQL} ON p.person = v.person WHERE l.actor_type = 'dashboard' GROUP BY ALL)"


@tool("query_id:s team:s views:l", f"SELECT * FROM {WEIGHTS_SQL}")
def cost_viewer_weights(t):
    return att.viewer_weights(log(t), views(t), members(t))


def costs(t) -> DataFrame:
    units = (F.col("event_id") * 37_000_000_001).cast("decimal(38,0)")
    usd = (units.cast("decimal(22,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(30,12)")
    return log(t).select("query_id", F.lit("scan").alias("model"), usd.alias("usd"))


PAID_SQL = f"""(SELECT query_id, team, usd FROM ({SPLIT.format(out="query_id, team", by="query_id", key="team", up="FALSE", rows=f"SELECT query_id, team, CAST(views AS HUGEINT) AS w, CAST(event_id AS HUGEINT) * 37000000001 AS pool FROM {WEIGHTS_SQL} JOIN {LOG_SQL} USING (query_id)")})
UNION ALL SELECT query_id, team, event_id * 37000000001 / 1e12 FROM {ATTRIBUTED_SQL} a JOIN {LOG_SQL} USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM {WEIGHTS_SQL}))"""


def paid(t) -> DataFrame:
    return att.paid_by(costs(t), att.viewer_weights(log(t), views(t), members(t)), attributed(t))


@tool("query_id:s team:s usd:d", f"SELECT * FROM {PAID_SQL}")
def cost_viewer_split(t):
    return paid(t)


STORED_SQL = "(SELECT concat('2024-0', p_size % 3 + 1) AS month, p_brand AS team, sum(p_size) / 1000.0 AS usd FROM part GROUP BY ALL)"


def stored_usd(t) -> DataFrame:
    usd = (F.sum("p_size").cast("decimal(18,0)") * F.lit("0.001").cast("decimal(3,3)")).cast("decimal(30,12)")
    return t("part").groupBy(F.concat(F.lit("2024-0"), (F.col("p_size") % 3 + 1).cast("string")).alias("month"), F.col("p_brand").alias("team")).agg(usd.alias("usd"))


SHOWBACK_SQL = f"(SELECT strftime(started_at, '%Y-%m') AS month, x.team, 'scan' AS model, a.cost_kind, l.actor_type, sum(x.usd) AS usd FROM {PAID_SQL} x JOIN {LOG_SQL} l USING (query_id) JOIN {ATTRIBUTED_SQL} a USING (query_id) GROUP BY ALL UNION ALL SELECT month, team, 'cluster', 'storage', 'storage', usd FROM {STORED_SQL})"


def showback_rows(t) -> DataFrame:
    return att.showback(costs(t), log(t), attributed(t), att.viewer_weights(log(t), views(t), members(t)), stored_usd(t))


@tool("month:s team:s model:s cost_kind:s actor_type:s usd:d", f"SELECT month, team, model, cost_kind, actor_type, round(usd, 6) AS usd FROM {SHOWBACK_SQL}")
def cost_showback(t):
    return showback_rows(t).withColumn("usd", F.round(F.col("usd").cast("double"), 6))


@tool("node_id:s refreshes:l views:l usd:d owner_share:d", f"SELECT node_id, count(DISTINCT x.query_id) AS refreshes, ifnull((SELECT count(*) FROM {VIEWS_SQL} v JOIN {MEMBERS_SQL} USING (person) WHERE v.exposure = node_id), 0) AS views, round(sum(usd), 6) AS usd, round(sum(CASE WHEN x.team = a.team THEN usd ELSE 0 END) / sum(usd), 4) AS owner_share FROM {PAID_SQL} x JOIN {LOG_SQL} l USING (query_id) JOIN {ATTRIBUTED_SQL} a USING (query_id) WHERE actor_type = 'dashboard' GROUP BY node_id")
def cost_dashboards(t):
    out = att.dashboards(log(t), views(t), members(t), attributed(t), paid(t))
    return out.withColumn("usd", F.round(F.col("usd").cast("double"), 6))


# Advice.

CASE_SQL = "(SELECT month, count(*) AS days, count(*) FILTER (WHERE d <= DATE '1996-02-10') AS legacy_days, round(900.0 * legacy_days / n, 6) AS legacy_usd, round(600.0 * days / n, 6) AS new_usd, round(round(600.0 * days / n, 6) * legacy_days / days, 6) AS overlap_usd FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS month, day(last_day(o_orderdate)) AS n FROM orders) GROUP BY month, n)"


def case_of(t) -> DataFrame:
    return att.business_case(t("orders").select(F.to_date("o_orderdate").alias("day")).distinct(), F.lit("1996-02-10").cast("date"), 900.0, 600.0)


@tool("month:s days:l legacy_days:l legacy_usd:d new_usd:d overlap_usd:d", f"SELECT * FROM {CASE_SQL}")
def cost_business_case(t):
    return case_of(t)


@tool("overlap_usd:d monthly_saving:d payback_months:d", f"SELECT round(sum(overlap_usd), 4) AS overlap_usd, 300.0 AS monthly_saving, round(sum(overlap_usd) / 300.0, 1) AS payback_months FROM {CASE_SQL}")
def cost_payback(t):
    return att.payback(case_of(t), 900.0, 600.0).withColumn("overlap_usd", F.round(F.col("overlap_usd").cast("double"), 4))


UNUSED_SQL = f"""SELECT b.d AS lookback_days, unique_id, relation, ifnull(team, 'unattributed') AS team, ifnull(owner, 'unattributed') AS owner FROM (SELECT unnest([30, 60, 100]) AS d) b, {NODES_SQL} LEFT JOIN {OWNERS_SQL} USING (unique_id)
WHERE resource_type = 'model' AND unique_id IN (SELECT ifnull(attached_node, x.unique_id) FROM {LOG_SQL} l JOIN {NODES_SQL.replace(' n(', ' x(')} ON x.unique_id = l.node_id WHERE actor_type = 'dbt' AND query_kind = 'Insert')
AND NOT EXISTS (SELECT 1 FROM {LOG_SQL} l WHERE actor_type IN ('dashboard', 'adhoc') AND started_at >= TIMESTAMP '2024-04-01 00:00:00' - INTERVAL 1 DAY * b.d AND (t1 IN (SELECT relation FROM {NODES_SQL.replace(' n(', ' y(')} WHERE y.unique_id = n.unique_id OR y.unique_id IN (SELECT node FROM {PATHS_SQL} q WHERE q.ancestor = n.unique_id))))"""


@tool("lookback_days:l unique_id:s relation:s team:s owner:s", UNUSED_SQL)
def cost_unused_tables(t):
    end = F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")
    return att.unused_tables(log(t), nodes(t), owners(t), graph.closure(links(t)), end, [30, 60, 100])


CANDIDATES_SQL = f"""SELECT row_number() OVER (ORDER BY usd DESC, unique_id) AS rank, unique_id, usd, array_to_string(src, ',') AS sources, array_to_string(list_filter(src, lambda s: s IN ('s0', 's3')), ',') AS blocked_by
FROM (SELECT n.unique_id, usd, list_sort(ifnull((SELECT list(DISTINCT ancestor) FROM {PATHS_SQL} q WHERE q.node = n.unique_id AND ancestor LIKE 's%'), [])) AS src FROM {NODES_SQL} JOIN (SELECT node_id AS unique_id, round(sum(bytes_scanned) / 1e6, 3) AS usd FROM {LOG_SQL} WHERE actor_type = 'dbt' GROUP BY ALL) USING (unique_id) WHERE resource_type = 'model' AND materialized NOT IN ('incremental', 'view') ORDER BY usd DESC, unique_id LIMIT 6)"""


@tool("rank:l unique_id:s usd:d sources:s blocked_by:s", CANDIDATES_SQL)
def cost_incremental_candidates(t):
    spent = log(t).where("actor_type = 'dbt'").groupBy(F.col("node_id").alias("unique_id")).agg(F.round(F.sum("bytes_scanned") / 1e6, 3).alias("usd"))
    out = att.incremental_candidates(spent, nodes(t), graph.closure(links(t)), ["s0", "s3"], 6)
    return out.withColumns({c: F.array_join(c, ",") for c in ("sources", "blocked_by")})


# Ownership, of a dataset for every customer.

REG_RULES = [("m*", "eve", "finance", "fay"), ("m[0-3]*", "cat", "sales", "dan"), ("m*7", "fay", "finance", None), ("m7*", "eve", "finance", None), ("a*", "ann", "platform", None), ("a3*", "zed", "platform", None), ("b??", "dan", "sales", "dan"), ("b[!1]*", "gus", "nowhere", None), ("zz?", "eve", "finance", None)]
REG_COLUMNS = {
    "unique_id": "concat(lower(substr(c_mktsegment, 1, 1)), c_custkey)",
    "resource_type": "CASE WHEN c_custkey % 11 = 0 THEN 'exposure' WHEN c_custkey % 3 = 0 THEN 'source' ELSE 'model' END",
    "declared_owner": "CASE c_custkey % 4 WHEN 0 THEN 'dan' WHEN 1 THEN 'eve' END",
}
REG_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in REG_COLUMNS.items())} FROM customer) n"
RULES_SQL = literal(REG_RULES, "r(match, owner, team, backup)")
HITS_SQL = f"(SELECT unique_id AS node, match, owner, team, len(regexp_replace(match, '\\[[^\\]]*\\]', '', 'g')) - len(regexp_replace(match, '\\[[^\\]]*\\]|[^*?]', '', 'g')) AS lit, len(regexp_replace(regexp_replace(match, '\\[[^\\]]*\\]', '*', 'g'), '[^*?]', '', 'g')) AS wild FROM {REG_SQL} JOIN {RULES_SQL} ON unique_id GLOB match)"
RESOLVED_SQL = f"(SELECT node, match, owner, team, count(*) FILTER (WHERE k = 1) OVER (PARTITION BY node) > 1 AS ambiguous, r FROM (SELECT *, rank() OVER (PARTITION BY node ORDER BY lit DESC, wild) AS k, row_number() OVER (PARTITION BY node ORDER BY lit DESC, wild, match) AS r FROM {HITS_SQL}) QUALIFY r = 1)"
BROKEN_SQL = f"(SELECT match, CASE WHEN team NOT IN (SELECT team FROM {MEMBERS_SQL}) THEN 'unknown team' WHEN owner NOT IN (SELECT person FROM {MEMBERS_SQL} WHERE p.team = r.team) THEN 'owner is not a member' WHEN backup IS NOT NULL AND (backup = owner OR backup NOT IN (SELECT person FROM {MEMBERS_SQL} WHERE p.team = r.team)) THEN 'backup is not another member' END AS problem FROM {RULES_SQL})"


def registry_rules_of(t) -> DataFrame:
    return rows_of(t, REG_RULES, "match string, owner string, team string, backup string")


def owned_nodes(t) -> DataFrame:
    return t("customer").selectExpr(*[f"{e} AS {c}" for c, e in REG_COLUMNS.items()]).withColumnsRenamed({"unique_id": "node", "resource_type": "kind"})


@tool("node:s match:s owner:s team:s ambiguous:b", f"SELECT node, match, owner, team, ambiguous FROM {RESOLVED_SQL}")
def registry_resolve(t):
    return graph.resolve(owned_nodes(t), registry_rules_of(t))


@tool("level:s subject:s finding:s", f"SELECT 'error' AS level, match AS subject, problem AS finding FROM {BROKEN_SQL} WHERE problem IS NOT NULL UNION ALL SELECT 'error', unique_id, f FROM (SELECT unique_id, CASE WHEN r.node IS NULL THEN 'has no owner' WHEN ambiguous THEN 'has ambiguous ownership' WHEN resource_type = 'exposure' AND n.declared_owner IS DISTINCT FROM r.owner THEN 'declares another owner' END AS f FROM {REG_SQL} LEFT JOIN {RESOLVED_SQL} r ON r.node = unique_id) WHERE f IS NOT NULL UNION ALL SELECT 'warning', match, 'matches no dataset' FROM {literal(REG_RULES, 'z(match, owner, team, backup)')} WHERE match NOT IN (SELECT match FROM {HITS_SQL})")
def registry_check(t):
    return graph.registry_check(owned_nodes(t), registry_rules_of(t), members(t))


COVERAGE_SQL = f"(SELECT resource_type AS kind, count(*) AS n_nodes, count(*) FILTER (WHERE ok) AS n_owned, count(DISTINCT CASE WHEN ok THEN team END) AS n_teams FROM (SELECT resource_type, team, r.node IS NOT NULL AND NOT ambiguous AND match NOT IN (SELECT match FROM {BROKEN_SQL} WHERE problem IS NOT NULL) AS ok FROM {REG_SQL} LEFT JOIN {RESOLVED_SQL} r ON r.node = unique_id) GROUP BY ALL)"


@tool("kind:s n_nodes:l n_owned:l n_teams:l", f"SELECT * FROM {COVERAGE_SQL}")
def registry_coverage(t):
    return graph.coverage(owned_nodes(t), registry_rules_of(t), members(t))


@tool("match:s n_nodes:l", "SELECT match, count(*) AS n_nodes FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY p) >= 3 AND p <> '' THEN concat(p, '_*') ELSE name END AS match FROM (SELECT concat(lower(n_name), '_', n_regionkey) AS name, concat(CAST(n_regionkey AS VARCHAR), '_', n_name) AS other FROM nation) q, (SELECT 1) z, LATERAL (SELECT regexp_extract(other, '^([^_]+)_', 1) AS p)) GROUP BY ALL HAVING FALSE UNION ALL SELECT concat(r, '_*'), n FROM (SELECT CAST(n_regionkey AS VARCHAR) AS r, count(*) AS n FROM nation GROUP BY ALL) WHERE n >= 3 UNION ALL SELECT concat(n_regionkey, '_', n_name), 1 FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY ALL HAVING count(*) < 3)")
def registry_starter(t):
    names = t("nation").select(F.concat(F.col("n_regionkey").cast("string"), F.lit("_"), F.col("n_name")).alias("node"))
    return graph.starter_rules(names)


@tool("parent_id:s child_id:s parent_type:s child_type:s", f"SELECT DISTINCT parent_id, child_id, split_part(parent_id, '_', 1) AS parent_type, split_part(child_id, '_', 1) AS child_type FROM {EDGE_SQL} WHERE parent_id IN (SELECT child_id FROM {EDGE_SQL})")
def lineage_edges(t):
    """Edges between known nodes; what a node names beside them (here regions, which are none, and a ghost) is left out."""
    depends = edges(t).groupBy(F.col("child_id").alias("unique_id")).agg(F.array_append(F.collect_set("parent_id"), F.lit("ghost")).alias("depends_on"))
    return graph.edge_rows(graph.build(depends), depends.select("unique_id", F.split_part("unique_id", F.lit("_"), F.lit(1)).alias("resource_type")))
