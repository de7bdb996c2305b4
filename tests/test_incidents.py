"""The incident desk, artifacts, and table operations that no SQL stands beside."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import cost, graph, incidents, reconcile
from lakeloom.sources import artifacts, tables

AT = datetime(2026, 3, 2, 2)
PARENTS = {"source.orders": (), "source.payments": (), "stg_orders": ("source.orders",), "stg_payments": ("source.payments",), "fct": ("stg_orders", "stg_payments"), "test.not_null": ("stg_orders",), "test.unique": ("fct",), "test.pay": ("stg_payments",)}
TESTS = {"stg_orders": ("test.not_null",), "fct": ("test.unique",), "stg_payments": ("test.pay",)}
DATASET = {"test.not_null": "stg_orders", "test.unique": "fct", "test.pay": "stg_payments"}
BROKEN = ([("test.not_null", "stg_orders")], [("stg_orders", "success"), ("test.not_null", "fail")])


def desk():
    return incidents.Desk(incidents.Graph(PARENTS, TESTS, DATASET))


def live(d):
    return [(i.number, i.root, i.resolved_by) for i in d.incidents if i.merged_into is None]


def test_the_same_invocation_twice_changes_nothing():
    d = desk()
    for _ in range(2):
        d.ingest("i1", "night-1", AT, *BROKEN)
    assert live(d) == [(1, "stg_orders", None)] and len(d.log) == 1


def test_a_later_part_with_the_root_merges_the_first_incident():
    d = desk()
    d.ingest("c1", "n", AT, [("fct", "fct")], [("fct", "error")])
    assert live(d) == [(1, "fct", None)]
    d.ingest("c2", "n", AT, *BROKEN)
    assert live(d) == [(2, "stg_orders", None)] and d.incidents[0].merged_into == 2


def test_a_root_is_resolved_only_by_a_run_that_covered_it_with_its_tests():
    d = desk()
    d.ingest("1", "night-1", AT, *BROKEN)
    d.ingest("2", "night-2", AT + timedelta(days=1), [], [("fct", "success"), ("test.unique", "pass")])
    d.ingest("3", "night-3", AT + timedelta(days=2), [], [("stg_orders", "success")])
    assert live(d) == [(1, "stg_orders", None)]
    d.ingest("3b", "night-3", AT + timedelta(days=2), [], [("test.not_null", "pass")])
    assert live(d) == [(1, "stg_orders", "night-3")]
    d.ingest("3c", "night-3", AT + timedelta(days=2), [("test.not_null", "stg_orders")], [("test.not_null", "fail")])
    assert live(d) == [(1, "stg_orders", None)] and d.log[-1][2] == "reopen"


def test_a_failure_below_an_open_root_that_was_not_checked_joins_it():
    d = desk()
    d.ingest("1", "night-1", AT, *BROKEN)
    d.ingest("2", "rerun", AT + timedelta(hours=7), [("fct", "fct")], [("fct", "error")])
    assert live(d) == [(1, "stg_orders", None)]
    d.ingest("3", "night-2", AT + timedelta(days=1), [("fct", "fct")], [("stg_orders", "success"), ("test.not_null", "pass"), ("fct", "error")])
    assert live(d) == [(1, "stg_orders", "night-2"), (2, "fct", None)]


def test_a_stale_feed_above_an_open_incident_is_the_same_problem():
    d = desk()
    d.ingest("1", "night-1", AT, [("stg_orders", "stg_orders")], [("stg_orders", "error")])
    d.ingest("2", "night-2", AT + timedelta(days=1), [("freshness:source.orders", "source.orders")], [("source.orders", "error")])
    assert live(d) == [(1, "stg_orders", None)]


def test_history_folds_projects_apart(spark):
    def rows(project, shift):
        out = []
        for k, (inv, run, failed, results) in enumerate([("1", "a", *BROKEN), ("1", "a", *BROKEN), ("2", "b", [], [("stg_orders", "success"), ("test.not_null", "pass")])][: 3 - shift]):
            bad = dict(failed)
            out += [(project, k, f"{project}{inv}", run, AT + timedelta(days=k), n, s, n if n in bad else None, bad.get(n)) for n, s in results]
        return out

    results = spark.createDataFrame(rows("p", 0) + rows("q", 1), "project string, arrival int, invocation_id string, run_id string, at timestamp, node string, status string, check_id string, subject string")
    lineage = spark.createDataFrame([(p, n, DATASET.get(n), list(PARENTS[n]), list(TESTS.get(n, ()))) for p in "pq" for n in PARENTS], "project string, node string, dataset string, parents array<string>, tests array<string>")
    found = {(r.project, r.number, r.root, r.opened_by, r.resolved_by) for r in incidents.history(results, lineage).collect()}
    assert found == {("p", 1, "stg_orders", "a", "b"), ("q", 1, "stg_orders", "a", None)}


MANIFEST = {
    "nodes": {
        "model.s.stg": {"unique_id": "model.s.stg", "resource_type": "model", "name": "stg", "schema": "staging", "depends_on": {"nodes": ["source.s.o"]}, "config": {"materialized": "view"}},
        "model.s.fct": {"unique_id": "model.s.fct", "resource_type": "model", "name": "fct", "schema": "marts", "depends_on": {"nodes": ["model.s.stg", "macro.x"]}},
        "test.s.nn": {"unique_id": "test.s.nn", "resource_type": "test", "name": "nn", "depends_on": {"nodes": ["model.s.stg", "macro.y"]}, "attached_node": "model.s.stg"},
        "test.s.src": {"unique_id": "test.s.src", "resource_type": "test", "name": "src", "depends_on": {"nodes": ["source.s.o"]}},
        "test.s.two": {"unique_id": "test.s.two", "resource_type": "test", "name": "two", "depends_on": {"nodes": ["model.s.stg", "model.s.fct"]}, "attached_node": "model.s.fct"},
    },
    "sources": {"source.s.o": {"unique_id": "source.s.o", "resource_type": "source", "name": "o", "schema": "raw", "identifier": "orders"}},
    "exposures": {"exposure.s.e": {"unique_id": "exposure.s.e", "name": "e", "owner": {"name": "ann"}, "depends_on": {"nodes": ["model.s.fct"]}}},
}


def test_artifacts(spark, tmp_path):
    run = {"metadata": {"invocation_id": "i1", "generated_at": "2026-03-02T02:14:09Z"}, "results": [{"unique_id": u, "status": s, "message": m} for u, s, m in [("model.s.stg", "error", "a\n  b"), ("test.s.nn", "fail", None), ("test.s.two", "error", "x" * 400), ("test.s.src", "fail", ""), ("model.s.fct", "skipped", None), ("test.s.gone", "fail", None), ("model.s.fct", "success", None)]]}
    fresh = {"metadata": {"invocation_id": "i2"}, "results": [{"unique_id": "source.s.o", "status": "error", "max_loaded_at": "2026-03-01", "age": 9000.0}, {"unique_id": "source.s.p", "status": "warn"}]}
    for name, data in (("manifest", MANIFEST), ("run", run), ("fresh", fresh)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    text = lambda name: artifacts.json_text(spark, str(tmp_path / f"{name}.json"))
    nodes = artifacts.manifest_nodes(text("manifest"))
    known = {r.unique_id: r for r in nodes.collect()}
    assert len(known) == 7 and known["exposure.s.e"].resource_type == "exposure" and known["exposure.s.e"].declared_owner == "ann"
    assert known["source.s.o"].relation == "raw.orders" and known["model.s.fct"].depends_on == ["model.s.stg"] and known["model.s.stg"].materialized == "view"
    results = artifacts.run_results(text("run"))
    failed = {(r.check_id, r.check_type, r.subject, r.status, len(r.message)) for r in artifacts.failures(results, nodes).collect()}
    assert failed == {("model.s.stg", "model", "model.s.stg", "error", 3), ("test.s.nn", "test", "model.s.stg", "fail", 0), ("test.s.two", "test", "test.s.two", "error", 300), ("test.s.src", "test", "source.s.o", "fail", 0)}
    assert [r.node for r in artifacts.skips(results, nodes).collect()] == ["model.s.fct"]
    stale = artifacts.stale_sources(artifacts.freshness_results(text("fresh"))).collect()
    assert [(r.check_id, r.message) for r in stale] == [("freshness:source.s.o", "max_loaded_at 2026-03-01, age 2.5 h")]
    assert artifacts.merged(artifacts.failures(results, nodes), artifacts.failures(results, nodes)).count() == 4


def test_registry_and_contracts(spark):
    members, rules = artifacts.registry(spark, "teams: [{id: a, members: [x, y]}, {id: b}]", "datasets: [{match: 'm.*', owner: x, team: a, backup: y}, {match: s, owner: z, team: b, tier: critical}]")
    assert sorted(map(tuple, members.collect())) == [("a", "x"), ("a", "y")]
    assert sorted(map(tuple, rules.collect()), key=str) == [("m.*", "x", "a", "standard", "y"), ("s", "z", "b", "critical", None)]
    with pytest.raises(ValueError, match="twice"):
        artifacts.registry(spark, "{}", "datasets: [{match: m, owner: x, team: a}, {match: m, owner: y, team: a}]")
    want = T.StructType.fromDDL("a int NOT NULL, b string, c double")
    assert artifacts.contract_problems(T.StructType.fromDDL("a long, c double, d int"), want) == ["a is bigint", "missing b", "unexpected d"]
    rows = spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string")
    assert [tuple(r) for r in artifacts.contract_rows(rows, want).collect()] == [("a is null", 1)]


def test_globs_and_specificity(spark):
    patterns = [("model.finance_*", 14, 1), ("model.*_v?", 8, 2), ("stg_[ab]*", 4, 2), ("model.[broken", 13, 0), ("a[!b]*", 1, 2), ("[]x]y", 1, 1), ("a.c", 3, 0), ("[!]]", 1, 1)]
    rules = spark.createDataFrame([(p, "o") for p, *_ in patterns], "match string, owner string")
    assert {(r.match, r._literal, r._wild) for r in graph.specific(rules).collect()} == set(patterns)
    names = ["model.finance_x", "model.q_v1", "stg_ax", "stg_cx", "model.[broken", "ab", "axb", "]y", "xy", "zy", "a.c", "abc", "q", "]"]
    import fnmatch

    want = {(n, p) for n in names for p, *_ in patterns if fnmatch.fnmatchcase(n, p)}
    got = {(r.node, r.match) for r in graph.candidates(spark.createDataFrame([(n,) for n in names], "node string"), rules).collect()}
    assert got == want


def test_long_chains_close_and_end_at_their_root(spark):
    n = 300
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n)], "parent_id string, child_id string")
    paths = graph.closure(edges)
    assert paths.count() == n * (n + 1) // 2 and paths.agg(F.max("depth")).first()[0] == n
    failed = spark.createDataFrame([(f"{i:03}",) for i in range(0, n + 1, 2)], "node string")
    assert {r.root for r in graph.roots(paths, failed).collect()} == {"000"}


CLASSES = [
    ("decimal", "4.35", "4.34", "rounding"), ("decimal", "10.00", "10.01", "value_mismatch"), ("decimal", "10.00", "10.02", "value_mismatch"), ("decimal", "10.00", "\\N", "value_mismatch"),
    ("decimal", "-4.35", "-4.34", "rounding"), ("ts", "2025-07-01T14:00:00.000000Z", "2025-07-01T18:00:00.000000Z", "timezone_shift"), ("ts", "2025-07-01T18:00:00.000000Z", "2025-07-01T14:00:00.000000Z", "timezone_shift"),
    ("ts", "2025-07-01T14:00:00.000000Z", "2025-07-01T19:00:00.000000Z", "value_mismatch"), ("ts", "2025-07-01T14:00:00.000000Z", "2025-07-01T14:30:00.000000Z", "value_mismatch"),
    ("text", "a@b.com ", "a@b.com", "whitespace"), ("text", "a@b.com", "A@B.COM", "case_only"), ("text", "card", "crypto", "value_mismatch"), ("text", "", "\\N", "value_mismatch"),
]


def test_classes_of_differences(spark):
    rows = spark.createDataFrame([(str(i), "c", k, a, b, want) for i, (k, a, b, want) in enumerate(CLASSES)], "row_key string, column_name string, kind string, a string, b string, want string")
    assert [(r.a, r.b) for r in reconcile.classified(rows).where("class <> want").collect()] == []
    cents = spark.range(1, 20_001).select(F.col("id").cast("string").alias("row_key"), (F.col("id") / 100).cast("decimal(12,2)").alias("x"))
    copied = cents.withColumn("y", (F.floor(F.col("x").cast("double") * 100) / 100).cast("decimal(12,2)")).where("x <> y")
    cells = copied.select("row_key", F.lit("c").alias("column_name"), F.lit("decimal").alias("kind"), F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b"))
    assert cells.count() > 100 and reconcile.classified(cells).where("class <> 'rounding'").isEmpty()


def test_explanations_need_a_cause_for_every_column(spark):
    need = spark.createDataFrame([("r", "revenue"), ("s", "revenue"), ("s", "orders"), ("u", "x"), ("v", "x")], "report string, column_name string")
    lineage = spark.createDataFrame([(r, c, "orders", k) for r in "rs" for c, k in (("revenue", "amount"), ("revenue", "status"), ("orders", "status"))], "report string, column_name string, table_name string, source_column string")
    upstream = spark.createDataFrame([("u", "customers"), ("v", "tickets")], "report string, table_name string")
    found = spark.createDataFrame([("orders", "amount"), ("customers", None)], "table_name string, source_column string")
    got = {r.report: (r.explained, r.causes) for r in reconcile.explained(need, lineage, upstream, found).collect()}
    assert got == {"r": (True, ["orders.amount"]), "s": (False, ["orders.amount"]), "u": (True, ["customers"]), "v": (False, [])}


def test_schema_drift_and_reports(spark):
    a, b = (spark.createDataFrame([], s) for s in ("id long, x string, at timestamp", "id long, y string, at string"))
    assert reconcile.schema_drift(a, b, ["id"], "at") == [("x", "missing in target"), ("y", "missing in source")]
    assert ("at", "change time is no timestamp") in reconcile.schema_drift(b, a, ["id"], "at") and ("k", "key is absent") in reconcile.schema_drift(a, b, ["k"])
    text = tables.markdown("Night", {"Rows": spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string"), "None": spark.createDataFrame([], "n int")}, most=1)
    assert text == "# Night\n\n## Rows\n\n| n | t |\n| --- | --- |\n| 1 | a\\|b |\n… and 1 more\n\n## None\n\nNothing.\n"


def test_replace_keeps_the_old_table_when_the_job_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(spark.range(5).toDF("n"), path)
    with pytest.raises(Exception, match="(?i)divi"):
        tables.replace(spark.read.parquet(path).select((F.lit(1) / (F.col("n") - F.col("n"))).alias("n")), path)
    assert spark.read.parquet(path).count() == 5
    tables.replace(spark.read.parquet(path).where("n > 2"), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [3, 4]


def test_snapshots_catalogues_and_pricing(spark):
    days = spark.createDataFrame([("2026-01-30", "a", 1, 10), ("2026-01-31", "a", 2, 20), ("2026-02-03", "a", 3, 30)], "d string, table_name string, rows long, bytes long").select(F.to_date("d").alias("day"), "table_name", "rows", "bytes")
    assert {tuple(r) for r in artifacts.at_month_end(days).collect()} == {("2026-01", "a", 2, 20), ("2026-02", "a", 3, 30)}
    text = json.dumps({"nodes": {"n": {"metadata": {"schema": "marts", "name": "t"}, "columns": {"A": {"name": "A", "type": "INT"}}}}, "sources": {}})
    assert [tuple(r) for r in artifacts.catalogue(spark.createDataFrame([(text,)], "value string")).collect()] == [("marts.t", "a", "INT")]
    at = lambda s: datetime(2026, 1, 5, 2) + timedelta(seconds=s)
    records = spark.createDataFrame([("q1", "dbt", at(0), 500), ("q2", "adhoc", at(0), 3000), ("q3", "adhoc", at(0), 2000), ("q4", "adhoc", at(900), 1000)], "query_id string, actor_type string, started_at timestamp, modeled_ms long")
    model = cost.WarehousePricing({"dbt": "build", "adhoc": "people"}, idle_ms=300_000, usd_per_hour=3600.0)
    usd = {r.query_id: float(r.usd) for r in model.price(records).collect()}
    assert usd == {"q1": 301.0, "q2": 183.0, "q3": 122.0, "q4": 301.0}
    scans = spark.createDataFrame([("q1", [1 << 40, 5])], "query_id string, table_bytes array<long>")
    assert round(cost.ScanPricing().price(scans).first().usd, 6) == round(6.25 * (1 + (10 << 20) / (1 << 40)), 6)


def test_a_connector_compares_as_of_a_watermark(spark):
    rules = {"id": reconcile.Rule("int"), "x": reconcile.Rule("text")}
    old = spark.createDataFrame([(i, f"v{i}", AT) for i in range(200)], "id long, x string, at timestamp")
    new = old.where("id <> 7").unionByName(spark.createDataFrame([(7, "new", AT + timedelta(hours=2)), (900, "late", AT + timedelta(hours=2))], "id long, x string, at timestamp"))
    mark = F.lit(AT + timedelta(hours=1))
    source, target = reconcile.TableConnector(new, ["id"], rules, "at", mark), reconcile.TableConnector(old, ["id"], rules)
    differ = reconcile.differing(source.summary(1), target.summary(1))
    found = reconcile.row_differences(source.fetch(1, differ), target.fetch(1, differ))
    assert [(r.row_key, r.kind) for r in found.collect()] == [("7", "extra")]
    assert [(r.row_key, r.kind) for r in reconcile.without_in_flight(found, source.keys_after(mark)).collect()] == [("7", "in_flight")]


def test_history_of_many_projects_streams_past_one_desk_at_a_time(spark):
    n = 3000
    results = spark.sql(f"SELECT concat('p', id % {n}) AS project, id DIV {n} AS arrival, CAST(id AS STRING) AS invocation_id, CAST(id AS STRING) AS run_id, timestamp_seconds(id) AS at, 'stg' AS node, if(id DIV {n} IN (1, 2, 4), 'error', 'success') AS status, if(id DIV {n} IN (1, 2, 4), 'stg', NULL) AS check_id, if(id DIV {n} IN (1, 2, 4), 'stg', NULL) AS subject FROM range({6 * n})")
    lineage = results.select("project").distinct().selectExpr("project", "'stg' AS node", "CAST(NULL AS STRING) AS dataset", "CAST(array() AS array<string>) AS parents", "CAST(array() AS array<string>) AS tests")
    found = incidents.history(results, lineage)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()  # no group, and no table, for each project
    got = {(r.project, r.number, int(r.opened_by), int(r.resolved_by), int(r.opened_at.timestamp()), int(r.resolved_at.timestamp())) for r in found.collect()}
    assert got == {(f"p{i}", k, a * n + i, b * n + i, a * n + i, b * n + i) for i in range(n) for k, a, b in ((1, 1, 3), (2, 4, 5))}


def test_a_run_looks_at_no_incident_closed_long_before():
    d = desk()
    for k in range(200):
        d.ingest(f"f{k}", f"f{k}", AT + timedelta(days=2 * k), *BROKEN)
        d.ingest(f"s{k}", f"s{k}", AT + timedelta(days=2 * k + 1), [], [("stg_orders", "success"), ("test.not_null", "pass")])
    assert len(d.incidents) == 200 and not d._open and all(len(x) == 1 for x in d._closed_by.values())
    d.ingest("late", "f3", AT + timedelta(days=6), [("fct", "fct")], [("fct", "error")])  # a later part of an old run still finds its own
    assert len(d.incidents) == 200 and d.incidents[3].merged_into is None
