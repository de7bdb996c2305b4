"""Queries of artifacts, registries, contracts, statements, the incident desk and result tables.

Documents and statements are made from the given tables, one for a customer or an event, and read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import graph, incidents, incremental, reconcile
from lakeloom.operators.statements import ColumnLineage
from lakeloom.plans import platform as co
from lakeloom.plans import results
from lakeloom.plans.toolkit import ALERTS, EDGE_SQL, edges, n_rows, tool
from lakeloom.sources import artifacts, generator, querylog, tables


# Artifacts: a project for every customer, whose orders are its models, each with a test.

ORDER_NODES = (
    # unique_id, resource_type, name, schema, alias, parents, attached node, materialized, of an order
    ("concat('model.o', o_orderkey)", "'model'", "concat('o', o_orderkey)", "'marts'", "CASE WHEN o_orderkey % 2 = 0 THEN concat('a', o_orderkey) END", "array(concat('source.c', o_custkey), 'macro.m')", "CAST(NULL AS STRING)", "CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'view' END"),
    ("concat('test.t', o_orderkey)", "'test'", "concat('t', o_orderkey)", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "CASE o_orderkey % 3 WHEN 0 THEN array(concat('model.o', o_orderkey), 'macro.x') WHEN 1 THEN array(concat('source.c', o_custkey)) ELSE array(concat('model.o', o_orderkey), concat('source.c', o_custkey)) END", "CASE WHEN o_orderkey % 3 <> 1 THEN concat('model.o', o_orderkey) END", "CAST(NULL AS STRING)"),
)


def manifests(t) -> DataFrame:
    """A JSON document for each customer with orders."""
    shape = "struct({0} AS key, named_struct('unique_id', {0}, 'resource_type', {1}, 'name', {2}, 'schema', {3}, 'alias', {4}, 'depends_on', named_struct('nodes', {5}), 'attached_node', {6}, 'config', named_struct('materialized', {7})) AS value)"
    each = t("orders").select("o_custkey", "o_orderkey", F.explode(F.array(*[F.expr(shape.format(*n)) for n in ORDER_NODES])).alias("n"))
    found = each.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list("n")).alias("nodes"), F.min("o_orderkey").alias("first"))
    source = "map(concat('source.c', o_custkey), named_struct('unique_id', concat('source.c', o_custkey), 'resource_type', 'source', 'name', 'c', 'schema', 'raw', 'identifier', concat('c', o_custkey)))"
    exposure = "map('e', named_struct('unique_id', concat('exposure.e', o_custkey), 'name', 'e', 'owner', named_struct('name', concat('p', o_custkey % 7)), 'depends_on', named_struct('nodes', array(concat('model.o', first)))))"
    return found.selectExpr(f"to_json(struct(nodes, {source} AS sources, {exposure} AS exposures)) AS value")


def runs(t) -> DataFrame:
    """Run results of every project: models, their tests, and tests that no manifest knows."""
    model = "named_struct('unique_id', concat('model.o', o_orderkey), 'status', CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'skipped' END, 'message', ' a\\n  b ')"
    test = "named_struct('unique_id', concat('test.t', o_orderkey), 'status', if(o_orderkey % 4 = 0, 'fail', 'pass'), 'message', concat('got ', o_orderkey, ' rows'))"
    gone = "named_struct('unique_id', concat('test.gone', o_orderkey), 'status', 'fail', 'message', '')"
    rows = t("orders").selectExpr("o_custkey", f"explode(array({model}, {test}, {gone})) AS r").groupBy("o_custkey").agg(F.collect_list("r").alias("results"))
    return rows.selectExpr("to_json(struct(named_struct('invocation_id', concat('i', o_custkey), 'generated_at', '2026-03-02T02:14:09Z') AS metadata, results)) AS value")


def freshness(t) -> DataFrame:
    one = "named_struct('unique_id', concat('source.c', o_custkey), 'status', CASE o_custkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'pass' END, 'max_loaded_at', CASE WHEN o_custkey % 10 = 0 THEN '2026-03-01' END, 'age', o_custkey * 360.0D)"
    return t("orders").select("o_custkey").distinct().selectExpr(f"to_json(struct(named_struct('invocation_id', 'f') AS metadata, array({one}) AS results)) AS value")


def values(rows, columns: str) -> str:
    return f"SELECT * FROM {co.literal(rows, f'v({columns})')}"


MODEL, SOURCE = "concat('model.o', o_orderkey)", "concat('source.c', o_custkey)"
TEST_PARENTS = f"CASE o_orderkey % 3 WHEN 0 THEN {MODEL} WHEN 1 THEN {SOURCE} ELSE concat({MODEL}, ',', {SOURCE}) END"


@tool("unique_id:s resource_type:s relation:s depends_on:s declared_owner:s materialized:s", f"""SELECT {MODEL} AS unique_id, 'model' AS resource_type, concat('marts.', CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'o' END, o_orderkey) AS relation, {SOURCE} AS depends_on, NULL AS declared_owner, CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'view' END AS materialized FROM orders
UNION ALL SELECT concat('test.t', o_orderkey), 'test', NULL, {TEST_PARENTS}, NULL, NULL FROM orders
UNION ALL SELECT DISTINCT {SOURCE}, 'source', concat('raw.c', o_custkey), '', NULL, NULL FROM orders
UNION ALL SELECT concat('exposure.e', o_custkey), 'exposure', NULL, concat('model.o', min(o_orderkey)), concat('p', o_custkey % 7), NULL FROM orders GROUP BY o_custkey""")
def artifact_manifest(t):
    return artifacts.manifest_nodes(manifests(t)).withColumn("depends_on", F.array_join("depends_on", ","))


@tool("check_id:s check_type:s subject:s status:s message:s", f"""SELECT {MODEL} AS check_id, 'model' AS check_type, {MODEL} AS subject, 'error' AS status, 'a b' AS message FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT concat('test.t', o_orderkey), 'test', CASE o_orderkey % 3 WHEN 0 THEN {MODEL} WHEN 1 THEN {SOURCE} ELSE concat('test.t', o_orderkey) END, 'fail', concat('got ', o_orderkey, ' rows') FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT DISTINCT concat('freshness:', {SOURCE}), 'freshness', {SOURCE}, 'error', printf('max_loaded_at %s, age %.1f h', CASE WHEN o_custkey % 10 = 0 THEN '2026-03-01' ELSE 'None' END, o_custkey / 10.0) FROM orders WHERE o_custkey % 5 = 0""")
def artifact_failures(t):
    """Failures of builds, of tests and of the freshness of sources, each once."""
    found = artifacts.failures(artifacts.run_results(runs(t)), artifacts.manifest_nodes(manifests(t)))
    return artifacts.merged(found, found, artifacts.stale_sources(artifacts.freshness_results(freshness(t))))


@tool("node:s", f"SELECT {MODEL} AS node FROM orders WHERE o_orderstatus = 'P'")
def artifact_skips(t):
    return artifacts.skips(artifacts.run_results(runs(t)), artifacts.manifest_nodes(manifests(t)))


@tool("parent_id:s child_id:s", f"""SELECT {SOURCE} AS parent_id, {MODEL} AS child_id FROM orders UNION ALL SELECT {MODEL}, concat('test.t', o_orderkey) FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT {SOURCE}, concat('test.t', o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT concat('model.o', min(o_orderkey)), concat('exposure.e', o_custkey) FROM orders GROUP BY o_custkey""")
def artifact_graph(t):
    return graph.build(artifacts.manifest_nodes(manifests(t)))


@tool("table_name:s column_name:s type:s", "SELECT concat(CASE WHEN o_custkey % 2 = 0 THEN 'marts.c' ELSE 'raw.c' END, o_custkey) AS table_name, concat('o', o_orderkey) AS column_name, o_orderstatus AS type FROM orders")
def artifact_catalogue(t):
    """Catalogues in which a customer is a table and an order a column."""
    columns = t("orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.expr("struct(concat('k', o_orderkey), named_struct('name', concat('O', o_orderkey), 'type', o_orderstatus))"))).alias("columns"))
    entry = "map('e', named_struct('metadata', named_struct('schema', if(o_custkey % 2 = 0, 'marts', 'raw'), 'name', concat('c', o_custkey)), 'columns', columns))"
    return artifacts.catalogue(columns.selectExpr(f"if(o_custkey % 2 = 0, to_json(struct({entry} AS nodes)), to_json(struct({entry} AS sources))) AS value"))


def registry_texts(t) -> tuple[str, str]:
    """A registry's YAML: regions as teams, their nations as members, a rule for every nation."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()  # a small table
    teams = "".join(f"- {{id: {r}, members: [{', '.join(x.n_name for x in rows if x.r_name == r)}]}}\n" for r in sorted({x.r_name for x in rows}))
    rules = "".join(f"- {{match: 'n{x.n_nationkey}.*', owner: {x.n_name}, team: {x.r_name}{', tier: critical' if x.n_nationkey % 4 == 0 else ''}{', backup: ' + x.n_name if x.n_nationkey % 3 == 0 else ''}}}\n" for x in rows)
    return f"teams:\n{teams}", f"datasets:\n{rules}"


@tool("match:s owner:s team:s tier:s backup:s", "SELECT concat('n', n_nationkey, '.*') AS match, n_name AS owner, r_name AS team, CASE WHEN n_nationkey % 4 = 0 THEN 'critical' ELSE 'standard' END AS tier, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS backup FROM nation JOIN region ON r_regionkey = n_regionkey")
def registry_rules(t):
    return artifacts.registry(t("region").sparkSession, *registry_texts(t))[1]


@tool("team:s person:s", "SELECT r_name AS team, n_name AS person FROM nation JOIN region ON r_regionkey = n_regionkey")
def registry_members(t):
    return artifacts.registry(t("region").sparkSession, *registry_texts(t))[0]


@tool("problem:s", values([("missing r_comment",), ("unexpected r_regionkey",), ("r_name is string",)], "problem"))
def contract_schema(t):
    found = artifacts.contract_problems(t("region").schema, T.StructType.fromDDL("r_name int, r_comment string"))
    return co.rows_of(t, [(p,) for p in found], "problem string")


@tool("problem:s rows:l", "SELECT 'value is null' AS problem, count(*) AS rows FROM events WHERE event_id % 3 = 0")
def contract_nulls(t):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return artifacts.contract_rows(rows, T.StructType.fromDDL("event_id long NOT NULL, value double NOT NULL"))


@tool("column_name:s problem:s", values([("n_name", "missing in target"), ("r_name", "missing in source"), ("n_nationkey", "missing in target"), ("n_regionkey", "missing in target"), ("r_regionkey", "missing in source"), ("n_nationkey", "key is absent"), ("n_name", "change time is no timestamp")], "column_name, problem"))
def schema_drift(t):
    return co.rows_of(t, reconcile.schema_drift(t("nation"), t("region"), ["n_nationkey"], "n_name"), "column_name string, problem string")


@tool("table_name:s sorting_key:s engine:s", "SELECT n_name AS table_name, CASE WHEN n_nationkey % 2 = 0 THEN concat('k', n_regionkey, ', at') ELSE '' END AS sorting_key, CASE WHEN n_nationkey % 2 = 0 THEN 'sorted' ELSE 'view' END AS engine FROM nation")
def catalogue_options(t):
    rows = t("nation").collect()  # a table a nation
    return artifacts.table_options(t("region").sparkSession, {r.n_name: ([f"k{r.n_regionkey}", "at"], "sorted") if r.n_nationkey % 2 == 0 else ([], "view") for r in rows})


@tool("month:s table_name:s rows:l bytes:l", "SELECT strftime(max(d), '%Y-%m') AS month, event_type AS table_name, arg_max(n, d) AS rows, arg_max(b, d) AS bytes FROM (SELECT CAST(ts + INTERVAL 1 DAY * (event_id % 40) AS DATE) AS d, event_type, count(*) AS n, sum(event_id) AS b FROM events GROUP BY ALL) GROUP BY event_type, date_trunc('month', d)")
def storage_month_end(t):
    days = t("events").groupBy(F.to_date(F.expr("ts + INTERVAL '1' DAY * (event_id % 40)")).alias("day"), F.col("event_type").alias("table_name")).agg(n_rows().alias("rows"), F.sum("event_id").alias("bytes"))
    return artifacts.at_month_end(days)


# Statements that users of the shop's tables would run: what they say depends on the event.

SHOP_TABLES = ("customer", "supplier", "nation", "part", "orders")
ASKED = {
    0: "concat('SELECT c_name FROM shop.customer WHERE c_custkey = ', user_id)",
    1: "concat('SELECT n.n_name, avg(s.s_acctbal) FROM shop.supplier s JOIN shop.nation n ON n.n_nationkey = s.s_nationkey WHERE s.s_acctbal > ', event_id % 1000, '.5 GROUP BY n.n_name')",
    2: "concat('INSERT INTO shop.part SELECT * FROM shop.part WHERE p_partkey BETWEEN ', event_id, ' AND ', event_id + 9)",
    3: "concat('SELECT FROM WHERE ', event_id)",
}
#: (which statement, table, column, whether it is filtered by)
READS = [(0, "customer", "c_name", False), (0, "customer", "c_custkey", True), (1, "supplier", "s_acctbal", True), (1, "supplier", "s_nationkey", False), (1, "nation", "n_name", False), (1, "nation", "n_nationkey", False)]


def shop(t) -> dict[str, dict[str, str]]:
    return {f"shop.{name}": {f.name: f.dataType.simpleString().upper() for f in t(name).schema.fields} for name in SHOP_TABLES}


@tool("table_name:s column_name:s filtered:b writes:s statements:l", f"""SELECT table_name, column_name, filtered, NULL AS writes, count(*) AS statements FROM events JOIN {co.literal([(k, f"shop.{t}", c, f) for k, t, c, f in READS], "r(k, table_name, column_name, filtered)")} ON k = event_id % 4 GROUP BY ALL
UNION ALL SELECT 'shop.part', column_name, column_name = 'p_partkey', 'shop.part', (SELECT count(*) FROM events WHERE event_id % 4 = 2) FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name)""")
def statement_reads(t):
    """How often the statements of all events read, filter by and write each column; those that can't be read don't count."""
    text = F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {e}" for k, e in ASKED.items()) + " END")
    found = querylog.statement_reads(t("events").select(F.col("event_id").alias("query_id"), text.alias("sql_text")), shop(t))
    each = found.select("table_name", "filter_columns", "writes", F.explode("columns").alias("column_name"))
    return each.groupBy("table_name", "column_name", F.array_contains("filter_columns", F.col("column_name")).alias("filtered"), "writes").agg(n_rows().alias("statements"))


#: Models over the shop, and what their columns come from.
MODELS = {
    "buyers": "SELECT c_custkey AS buyer, upper(c_name) AS name, c_nationkey AS land FROM shop.customer WHERE c_acctbal > 0",
    "sales": "SELECT b.buyer, b.land, o.o_totalprice AS price, year(o.o_orderdate) AS sold_in FROM shop.orders o JOIN models.buyers b ON b.buyer = o.o_custkey",
    "lands": "SELECT s.sold_in, n.n_name AS land_name, sum(s.price) AS turnover FROM models.sales s LEFT JOIN shop.nation n ON n.n_nationkey = s.land GROUP BY s.sold_in, n.n_name",
    "lost": "SELECT x FROM elsewhere.gone",
}
_SOLD = ("c_custkey", "c_acctbal", "o_custkey")  # an inner join's and a filter's columns feed every column
_LANDS = ("o_orderdate", "n_name", "n_nationkey", "c_nationkey", *_SOLD)  # so do those grouped by
TRACED = {
    ("buyers", "buyer"): ("c_custkey", "c_acctbal"), ("buyers", "name"): ("c_name", "c_acctbal"), ("buyers", "land"): ("c_nationkey", "c_acctbal"),
    ("sales", "buyer"): _SOLD, ("sales", "land"): ("c_nationkey", *_SOLD), ("sales", "price"): ("o_totalprice", *_SOLD), ("sales", "sold_in"): ("o_orderdate", *_SOLD),
    ("lands", "sold_in"): _LANDS, ("lands", "land_name"): _LANDS, ("lands", "turnover"): ("o_totalprice", *_LANDS),
}
OWN = {"c": "customer", "o": "orders", "n": "nation"}
TRACED_SQL = co.literal([(m, c, OWN[s[0]], s) for (m, c), sources in TRACED.items() for s in sources], "l(model, column_name, table_name, source_column)")
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS source_column, count({c}) AS n_values FROM {OWN[c[0]]}" for c in sorted({c for x in TRACED.values() for c in x}))


@tool("model:s column_name:s table_name:s source_column:s n_values:l", f"SELECT model, column_name, table_name, source_column, n_values FROM {TRACED_SQL} JOIN ({COUNTS_SQL}) USING (source_column)")
def column_lineage(t):
    """The source columns behind each column of the models, with how many values they hold."""
    lineage = co.rows_of(t, ColumnLineage(t("region").sparkSession, MODELS, shop(t)).rows(), "model string, column_name string, table_name string, source_column string")
    counts = [t(name).agg(*[F.count(c).alias(c) for c in t(name).columns]).unpivot([], t(name).columns, "source_column", "n_values") for name in ("customer", "orders", "nation")]
    return lineage.join(counts[0].unionAll(counts[1]).unionAll(counts[2]), "source_column")


# The incident desk: every customer is a project, every order a run, in which the staging model fails (status O), builds
# (F), or is not looked at (P).

DESK_SQL = """WITH runs AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
looked AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY c ORDER BY n), 'F') AS before FROM runs WHERE s <> 'P'),
opened AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n) AS number FROM looked WHERE s = 'O' AND before = 'F')
SELECT concat('c', c) AS project, number, 'stg' AS root, CAST(k AS VARCHAR) AS opened_by, CAST((SELECT arg_min(l.k, l.n) FROM looked l WHERE l.c = o.c AND l.n > o.n AND l.s = 'F') AS VARCHAR) AS resolved_by, NULL AS merged_into FROM opened o"""


@tool("project:s number:l root:s opened_by:s resolved_by:s merged_into:l", DESK_SQL)
def incident_history(t):
    """A first failure opens an incident, further ones are its updates, the next build that succeeds closes it."""
    arrival = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("arrival")
    failed = F.when(F.col("o_orderstatus") == "O", "stg")
    node = F.when(F.col("o_orderstatus") == "P", "other").otherwise("stg")
    status = F.when(F.col("o_orderstatus") == "O", "error").otherwise("success")
    run, project = F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    rows = t("orders").select(project.alias("project"), arrival, run.alias("invocation_id"), run.alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("at"), node.alias("node"), status.alias("status"), failed.alias("check_id"), failed.alias("subject"))
    empty = F.array().cast("array<string>")
    lineage = rows.select("project").distinct().select("project", F.explode(F.array(F.lit("stg"), F.lit("other"))).alias("node"), F.lit(None).cast("string").alias("dataset"), empty.alias("parents"), empty.alias("tests"))
    return incidents.history(rows, lineage)


# History, faults, results.


@tool("user_id:l event_id:l valid_from:z valid_to:z", "SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1)")
def snapshot_merge(t):
    """A snapshot of half of the versions after the other half arrives, some of them again."""
    first = t("events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    old = incremental.snapshot(first.where("event_id % 2 = 0"), "user_id", "ts")
    return incremental.merge_snapshot(old, first.where("event_id % 2 = 1 OR event_id % 6 = 0"), "user_id", "ts")


HIT = "CAST(concat('0x', substr(md5(concat('7:', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) % 5 = 0"


@tool("order_id:l customer_id:l status:s", f"SELECT o_orderkey AS order_id, CASE WHEN {HIT} THEN NULL ELSE o_custkey END AS customer_id, o_orderstatus AS status FROM orders")
def fault_null_spike(t):
    rows = t("orders").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS status")
    return generator.planted(rows, generator.FAULTS[0], 7)


@tool("row_key:s column_name:s label:s", f"SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'customer_id' AS column_name, 'F1' AS label FROM orders WHERE {HIT}")
def fault_truth(t):
    return generator.truth(t("orders").select(F.col("o_orderkey").alias("order_id")), generator.FAULTS[0], 7)


#: What each fault's table is here (the given table, and its columns by the names that the fault knows), and how a row
#: that was hit can be told.
FAULTY = {
    "orders": ("orders", "o_orderkey AS order_id, o_custkey AS customer_id"), "support_tickets": ("events", "event_id AS ticket_id, event_type AS priority"), "payments": ("orders", "o_orderkey AS payment_id, o_orderkey + 1 AS order_id, o_orderstatus AS status"),
    "web_sessions": ("events", "event_id AS session_id, event_type AS device"), "marketing_spend": ("part", "p_partkey AS spend_id, p_size AS clicks"), "marketing_campaigns": ("supplier", "s_suppkey AS campaign_id, s_name AS channel"),
}
MARKED = {"null_spike": "{c} IS NULL", "loader_nulls": "{c} IS NULL", "invalid_category": "{c} = '{v}'", "orphan_keys": "{c} < 0"}


def fault_sql(f: generator.Fault) -> str:
    table, columns = FAULTY[f.table]
    key = columns.split(" AS ")[0]
    hit = f"CAST(concat('0x', substr(md5(concat('7:', {key})), 1, 8)) AS BIGINT) % 5 = 0"
    names = sorted(f"{c.split(' AS ')[1]}{'_v2' if f.kind == 'schema_rename' and c.endswith(f' {f.column}') else ''}" for c in columns.split(", ") if not (f.kind == "schema_drop" and c.endswith(f" {f.column}")))
    rows = {"volume_drop": f"count(*) FILTER (WHERE {hit})", "stale_source": "count(*) FILTER (WHERE FALSE)"}.get(f.kind, "count(*)")
    return f"SELECT '{f.fault_id}' AS fault, {rows} AS n_rows, {f'count(*) FILTER (WHERE {hit})' if f.kind in MARKED else '0'} AS n_hit, '{','.join(names)}' AS columns FROM {table}"


@tool("fault:s n_rows:l n_hit:l columns:s", " UNION ALL ".join(fault_sql(f) for f in generator.FAULTS))
def fault_effects(t):
    """Rows, rows hit and columns of a table under each of the nine faults."""
    out = []
    for f in generator.FAULTS:
        table, columns = FAULTY[f.table]
        rows = generator.planted(t(table).selectExpr(*columns.split(", ")), f, 7)
        hit = F.count_if(F.expr(MARKED[f.kind].format(c=f.column, v=f.value))) if f.kind in MARKED else F.lit(0)
        out.append(rows.agg(F.lit(f.fault_id).alias("fault"), F.count(F.lit(1)).alias("n_rows"), hit.alias("n_hit"), F.lit(",".join(sorted(rows.columns))).alias("columns")))
    return reduce(DataFrame.unionAll, out)


@tool("resource_type:s datasets:l teams:l critical:l", f"SELECT resource_type, count(*) AS datasets, count(DISTINCT team) AS teams, count(*) FILTER (WHERE resource_type = 'source') AS critical FROM {co.REG_SQL} JOIN {co.RESOLVED_SQL} r ON r.node = n.unique_id GROUP BY ALL")
def result_ownership_coverage(t):
    owned = co.owned_nodes(t).join(graph.resolve(co.owned_nodes(t), co.registry_rules_of(t)), "node").withColumnsRenamed({"node": "unique_id", "kind": "resource_type"})
    owned = owned.withColumn("tier", F.when(F.col("resource_type") == "source", "critical").otherwise("standard"))
    return results.ask("ownership_coverage", {"node_ownership": owned})


@tool("actor_type:s queries:l bytes_read:d", f"SELECT actor_type, count(*) AS queries, sum(bytes_scanned) AS bytes_read FROM {co.LOG_SQL} GROUP BY ALL")
def result_workload(t):
    return results.ask("workload", {"query_log": co.log(t)})


@tool("edges:l", f"SELECT count(*) AS edges FROM {EDGE_SQL}")
def result_lineage(t):
    return results.ask("lineage", {"lineage_edges": edges(t)})


@tool("incident_id:l severity:s fixed_at:z fault_id:s", f"SELECT event_id AS incident_id, severity, CASE WHEN event_id % 2 = 0 THEN closed_at END AS fixed_at, CASE WHEN event_id % 3 = 0 THEN 'F1' END AS fault_id FROM ({ALERTS}) WHERE event_id % 7 <> 0")
def result_incidents(t):
    from lakeloom.plans.toolkit import alerts

    rows = alerts(t).withColumnRenamed("event_id", "incident_id")
    more = {c: F.lit(None).cast("string") for c in ("root", "score", "owner", "team", "resolved_at")}
    made = rows.withColumns({**more, "seq": F.col("incident_id"), "merged_into": F.when(F.col("incident_id") % 7 == 0, 1)})
    replies = rows.where("incident_id % 2 = 0").select("incident_id", F.col("opened_at").alias("acknowledged_at"), F.col("closed_at").alias("fixed_at"))
    caused = rows.where("incident_id % 3 = 0").select("incident_id", F.lit("F1").alias("fault_id"))
    return results.ask("incidents", {"incidents": made, "incident_responses": replies, "fault_incidents": caused})


@tool("line:s", values([("# Night",), ("",), ("## Regions",), ("",), ("| r_regionkey | r_name |",), ("| --- | --- |",), ("| 0 | AFRICA |",), ("… and 4 more",)], "line"))
def report_text(t):
    """A text report, line by line."""
    lines = tables.markdown("Night", {"Regions": t("region").orderBy("r_regionkey")}, most=1).splitlines()
    return co.rows_of(t, [(x,) for x in lines], "line string")
