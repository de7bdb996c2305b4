"""Operators on hand-made rows, against plain Python."""

import datetime as dt
import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from lakeloom.functions.money import avg_half_up, boundaries
from lakeloom.operators import cost, graph, incremental, quality, reconcile


def test_average_is_rounded_half_away_from_zero(spark):
    rows = spark.createDataFrame([("a", Decimal("0.01")), ("a", Decimal("0.02")), ("b", None)], "k string, x decimal(10,2)")
    got = {r.k: r.m for r in rows.groupBy("k").agg(avg_half_up("x").alias("m")).collect()}
    assert got == {"a": Decimal("0.02"), "b": None}


def test_boundaries_count_borders(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 31, 10, 59), dt.datetime(2024, 2, 1, 11, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = rows.select(boundaries("hour", "a", "b").alias("h"), boundaries("month", "a", "b").alias("m")).first()
    assert (r.h, r.m) == (25, 1)


def test_shares_sum_exactly(spark):
    random.seed(3)
    pools = {f"p{i}": (Decimal(random.randint(1, 10**14)) / 10**12, [random.choice((0, 1, 1, random.randint(1, 10**9))) for _ in range(random.randint(1, 7))]) for i in range(40)}
    rows = [(p, f"k{j}", total, w) for p, (total, ws) in pools.items() for j, w in enumerate(ws)]
    df = cost.share(spark.createDataFrame(rows, "p string, k string, total decimal(20,12), w long"), "total", "w", ["p"], "k")
    got = {(r.p, r.k): r.usd for r in df.collect()}
    unit = Decimal("1e-12")
    for p, (total, ws) in pools.items():
        live = [(w, f"k{j}") for j, w in enumerate(ws) if w > 0]
        if not live:
            assert not any(q == p for q, _ in got)
            continue
        exact = {k: (total * w / sum(w for w, _ in live)).quantize(unit, ROUND_HALF_EVEN) for w, k in live}
        largest = min(live, key=lambda x: (-x[0], x[1]))[1]
        exact[largest] += total - sum(exact.values())
        assert {k: got[p, k] for _, k in live} == exact


def test_bursts_equal_a_sequential_queue(spark):
    random.seed(5)
    rows = [(f"w{i % 6}", random.randint(0, 4_000_000), i, random.randint(1, 90_000)) for i in range(600)]
    got = {r.id: (r.end_ms, r.burst) for r in cost.bursts(spark.createDataFrame(rows, "w string, s long, id long, ms long"), "w", "s", "id", "ms", 60_000).collect()}
    for w in {r[0] for r in rows}:
        end, burst = None, 0
        for _, s, i, ms in sorted((r for r in rows if r[0] == w), key=lambda r: (r[1], r[2])):
            if end is None or s > end + 60_000:
                burst += 1
            end = max(s, end or s) + ms
            assert got[i] == (end, burst)


def test_descent_finds_what_the_join_finds(spark):
    rules = {"id": reconcile.Rule("int"), "t": reconcile.Rule("text")}
    a = spark.range(5000).withColumn("t", F.concat(F.lit("item "), F.col("id").cast("string")))
    b = a.where("id <> 17").withColumn("t", F.when(F.col("id") == 40, "other").otherwise(F.col("t")))
    b = b.unionAll(spark.createDataFrame([(9999, "new"), (42, "item 42")], "id long, t string"))
    sides = [reconcile.hashed(x, ["id"], rules) for x in (a, b)]
    s, t, levels = reconcile.descend(*sides, leaf_rows=64)
    want = {("17", "missing"), ("9999", "extra"), ("42", "duplicate_key"), ("40", "changed")}
    for pair in (sides, (s, t)):
        assert {(r.row_key, r.kind) for r in reconcile.row_differences(*pair).collect()} == want
    assert levels.count() == 2 and s.count() < 200


def test_mismatch_classes(spark):
    rows = [
        ("decimal", "4.35", "4.34", "rounding"), ("decimal", "1.23", "1.10", "value_mismatch"), ("text", "a", "a ", "whitespace"),
        ("text", "a", "A", "case_only"), ("text", "a", "\\N", "value_mismatch"), ("text", "a", "b", "value_mismatch"), ("int", "1", "2", "value_mismatch"),
        ("ts", "2025-01-01T00:00:00.000000Z", "2025-01-01T05:00:00.000000Z", "timezone_shift"),
        ("ts", "2025-11-02T01:30:00.000000Z", "2025-11-02T06:30:00.000000Z", "timezone_shift"),
        ("ts", "2025-11-02T01:30:00.000000Z", "2025-11-02T05:30:00.000000Z", "timezone_shift"),
        ("ts", "2025-01-01T00:00:00.000000Z", "2025-01-01T03:00:00.000000Z", "value_mismatch"),
    ]
    df = spark.createDataFrame([(str(i), "c", *r) for i, r in enumerate(rows)], "row_key string, column_name string, kind string, a string, b string, want string")
    assert [(r.row_key, r["class"], r.want) for r in reconcile.classified(df).collect() if r["class"] != r.want] == []


def test_canonical_text(spark):
    rule = {"t": reconcile.Rule("text"), "d": reconcile.Rule("decimal"), "b": reconcile.Rule("bool")}
    df = spark.createDataFrame([("pipe|and\\", Decimal("-0.004"), True), (None, None, None), ("", Decimal("1.005"), False)], "t string, d decimal(10,3), b boolean")
    got = [tuple(r) for r in df.select(*[reconcile.canonical(c, r).alias(c) for c, r in rule.items()]).collect()]
    assert got == [("pipe\\|and\\\\", "0.00", "true"), ("\\N", "\\N", "\\N"), ("", "1.01", "false")]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "parent_id string, child_id string")
    paths = graph.closure(edges)
    assert {(r.ancestor, r.node): r.depth for r in paths.collect()} == {
        ("a", "b"): 1, ("a", "c"): 1, ("b", "d"): 1, ("c", "d"): 1, ("a", "d"): 2, ("d", "e"): 1, ("x", "e"): 1, ("b", "e"): 2, ("c", "e"): 2, ("a", "e"): 3,
    }
    failed = spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "node string")
    assert {r.node: r.root for r in graph.roots(paths, failed).collect()} == {"b": "b", "c": "c", "d": "b", "e": "b"}


def test_volume_fails_only_on_a_quiet_day(spark):
    rows = [(dt.datetime(2024, 1, 10) - dt.timedelta(hours=24 * d + h % 24, minutes=h),) for d in range(8) for h in range(20 if d else 5)]
    df = spark.createDataFrame([*rows, (dt.datetime(2024, 1, 10),)], "ts timestamp_ntz")
    assert [tuple(r) for r in quality.recent_volume(df, "ts").collect()] == [(6, 20.0)]
    assert quality.recent_volume(df.where("ts < '2024-01-08'"), "ts").isEmpty()


def test_month_rebuild_equals_full_build(spark, tmp_path):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1 + i % 4, 5)) for i in range(40)], "id long, t timestamp_ntz")
    old = rows.where("id < 30")
    incremental.write_months(old, str(tmp_path / "m"), "t")
    newest = F.lit("2024-04-05").cast("timestamp_ntz")
    incremental.write_months(incremental.recent_months(rows, "t", newest), str(tmp_path / "m"), "t")
    want = {r.id for r in old.collect()} | {r.id for r in incremental.recent_months(rows, "t", newest).collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "m")).collect()} == want


def test_snapshot_is_idempotent(spark):
    v = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 10, "c")], "k long, at long, x string")
    once = incremental.snapshot(v, "k", "at")
    twice = incremental.merge_snapshot(once, v, "k", "at")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.select(*once.columns).collect()), key=str)
    assert {(r.k, r.at): r.valid_to for r in once.collect()} == {(1, 10): 20, (1, 20): None, (2, 10): None}


def test_closure_continues_only_the_longest_paths_and_keeps_tasks_small(spark, monkeypatch):
    rng = random.Random(5)
    for n, m in ((12, 30), (40, 60), (30, 0)):  # with cycles and loops; sparse; one chain of 30
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] or [(i, i + 1) for i in range(n)]
        want, edge = {}, {(a, b): 1 for a, b in pairs}
        while edge:
            want.update(edge)
            edge = {(a, c): d + 1 for (a, b), d in edge.items() for x, c in pairs if x == b and (a, c) not in want}
        rows = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "parent_id string, child_id string")
        with monkeypatch.context() as m:
            m.setattr(graph, "TASK_ROWS", 100)
            assert sorted(map(tuple, graph.closure(rows).collect())) == sorted((f"{a:02}", f"{b:02}", d) for (a, b), d in want.items())
    hub = spark.range(20_000).selectExpr("'hub' AS parent_id", "concat('n', id) AS child_id")
    top = spark.createDataFrame([("top", "hub")], "parent_id string, child_id string")
    paths = graph.closure(top.unionAll(hub))
    assert paths.count() == 40_001
    failed = paths.select("node").unionAll(top.selectExpr("parent_id")).distinct()
    near = graph.nearest_failed(paths, failed)
    assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString() and near.where("nearest = 'hub'").count() == 20_000
    use = graph.impact(paths, failed.selectExpr("node", "2 AS weight", "'model' AS kind"))
    assert {tuple(r) for r in use.collect()} == {("top", 20_001, 40_002), ("hub", 20_000, 40_000)}
    assert "SortMergeJoin" not in use._jdf.queryExecution().executedPlan().toString()
