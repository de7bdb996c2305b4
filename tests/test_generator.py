"""Generated tables, faults, workload, day loop, result queries and builds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import results
from lakeloom.plans.build import build
from lakeloom.plans.warehouse import MODELS, Warehouse
from lakeloom.sources import generator, tables
from lakeloom.sources.generator import FAULTS, KEYS, Company, Generator

DATA = "/root/testdata/sf0.001"


def test_tables_are_the_same_every_time_and_keep_their_laws(spark):
    g = Generator(spark, 0.002)
    for name, key in KEYS.items():
        rows = g.table(name)
        assert rows.count() >= 10 and rows.select(key).distinct().count() == rows.count()
        assert tables.fingerprint(rows).first() == tables.fingerprint(Generator(spark, 0.002).table(name)).first()
    assert tables.fingerprint(g.orders()).first() != tables.fingerprint(Generator(spark, 0.002, 43).orders()).first()
    people = g.customers()
    twice = people.groupBy(F.lower(F.trim("email"))).count().where("count > 1").count()
    assert twice >= 1 and people.count() > g.n("customers")
    share = g.orders().agg(F.avg((F.col("status") == "completed").cast("double"))).first()[0]
    assert 0.78 < share < 0.9
    assert g.order_items().join(g.orders(), "order_id", "left_anti").isEmpty() and g.payments().join(g.orders(), "order_id", "left_anti").isEmpty()


def test_arrivals_over_all_days_are_the_table(spark):
    g = Generator(spark, 0.0003)
    days = [generator.START + timedelta(days=k) for k in range(0, 60)]
    fresh = [g.arrivals("orders", d) for d in days]
    both = fresh[0]
    for f in fresh[1:]:
        both = both.unionByName(f)
    upto = F.lit(days[-1] + timedelta(days=1)).cast("timestamp_ntz")
    want = g.orders().where(F.col("ordered_at") < upto)
    newest = both.groupBy("order_id").agg(F.max(F.struct("updated_at", "status"))["status"].alias("status"))
    assert newest.count() == want.count()
    settled = want.where(F.col("ordered_at") < F.lit(days[-3]).cast("timestamp_ntz")).select("order_id", "status")
    assert settled.exceptAll(newest).isEmpty()
    tickets = g.arrivals("support_tickets", generator.START + timedelta(days=30))
    assert {"updated_at", "status"} <= set(tickets.columns)


def test_every_fault_does_what_it_says(spark):
    g = Generator(spark, 0.001)
    for fault in FAULTS:
        rows = g.table(fault.table)
        bad = generator.planted(rows, fault, 7)
        hits = generator.truth(rows, fault, 7).count()
        if fault.kind in ("null_spike", "loader_nulls"):
            assert bad.where(F.col(fault.column).isNull()).count() == hits > 0
        elif fault.kind == "invalid_category":
            assert bad.where(F.col(fault.column) == fault.value).count() == hits > 0
        elif fault.kind == "orphan_keys":
            assert bad.where(F.col(fault.column) < 0).count() == hits > 0
        elif fault.kind == "volume_drop":
            assert bad.count() == hits < rows.count() / 2
        elif fault.kind == "stale_source":
            assert bad.isEmpty()
        else:
            assert fault.column not in bad.columns


def test_workload_and_days(spark):
    day = datetime(2025, 1, 1)
    rows = generator.workload(spark, {"exposure.a": 6, "exposure.b": 24}, ["ann", "bo"], ["SELECT 1 -- {day}", "SELECT 2"], day, 3, 42)
    n = {r.subject or r.person: r["count"] for r in rows.groupBy("subject", "person").count().collect()}
    assert n["ann"] == n["bo"] == 9 and n["exposure.b"] == 3 and n["exposure.a"] >= 9
    assert rows.exceptAll(generator.workload(spark, {"exposure.a": 6, "exposure.b": 24}, ["ann", "bo"], ["SELECT 1 -- {day}", "SELECT 2"], day, 3, 42)).isEmpty()
    done = Company(day, [("copy", lambda d: d.day), ("build", lambda d: "ok")]).run(3, lambda step, d: step == "copy" and d.day == 2)
    assert [(d.day, s) for d, s, _ in done] == [(1, "copy"), (1, "build"), (2, "build"), (3, "copy"), (3, "build")]


def test_result_queries(spark):
    assert len(results.QUERIES) == 23
    made = {}
    for name, query in results.QUERIES.items():
        for table in query.tables:
            words = query.sql.replace("CAST(", " ").replace(",", " ").replace("(", " ").replace(")", " ").split()
            skip = {"SELECT", "FROM", "ORDER", "BY", "AS", "DOUBLE", "DESC", "GROUP", "LEFT", "JOIN", "ON", "WHERE", "IS", "NULL", "DISTINCT", "=", "count", "*", "count_if", "sum", "coalesce", "0", "min", "'critical'"}
            columns = sorted({w.split(".")[-1] for w in words if w not in skip and "{" not in w and w not in ("i", "r", "f", "loads", "datasets", "teams", "critical", "edges", "queries", "bytes_read", "failing_checks", "invocations")})
            number = {"rows_read", "bytes_scanned", "checks_run", "days"}
            made[table] = spark.createDataFrame([tuple("1" for _ in columns)], ", ".join(f"{c} string" for c in columns)).select(*[F.col(c).cast("long") if c in number or c.endswith("usd") else F.lit(None).cast("string").alias(c) if c == "merged_into" else F.col(c) for c in columns])
        assert results.ask(name, made).count() == 1, name
    with pytest.raises(LookupError, match="cost_quotas"):
        results.ask("quotas", {})
    coverage = spark.createDataFrame([("model", "a", "critical"), ("model", "b", "low"), ("source", "a", "low")], "resource_type string, team string, tier string")
    assert [tuple(r) for r in results.ask("ownership_coverage", {"node_ownership": coverage}).collect()] == [("model", 2, 2, 1), ("source", 1, 1, 0)]
    nights = spark.createDataFrame([(1, "report", True, None, True, 5, 100), (1, "table", False, True, False, 50, 100), (2, "table", True, None, False, 1, 100)], "night int, level string, passed boolean, explained boolean, repaired boolean, rows_moved long, rows_moved_naive long")
    assert {tuple(r) for r in results.nights_status(nights).collect()} == {(1, "explained"), (2, "clean")}
    assert {tuple(r) for r in results.moved_rows(nights).collect()} == {("report", True, 5, 100, 0.95), ("table", False, 50, 100, 0.5), ("table", True, 1, 100, 0.99)}
    assert results.card("rpt_daily_x", {"period_start": False, "channel": False, "orders": True}).startswith("SELECT `period_start`, `channel`, sum(`orders`)")
    assert results.card("dim", {"a": True}, "a") == "SELECT * FROM `dim` ORDER BY a LIMIT 100"


def test_a_build_gives_what_the_plans_give(spark, tmp_path):
    names = [n for n in MODELS if "_rpt_" not in n or n.endswith("monthly_by_channel")]
    plain = Warehouse(spark, DATA)
    built = build(spark, DATA, str(tmp_path / "w"), names)
    for n in ("sales_fct_orders", "finance_fct_revenue", "sales_dim_customers", "marketing_fct_campaign_performance", "product_fct_sessions_v1", names[-1]):
        a, b = built(n), plain(n)
        assert sorted(a.columns) == sorted(b.columns) and a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty(), n
    again = build(spark, DATA, str(tmp_path / "w"), ["sales_fct_orders"], full=False)
    assert again("sales_fct_orders").exceptAll(plain("sales_fct_orders")).isEmpty()
