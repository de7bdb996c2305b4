"""Scans, selection and bitmaps against plain Python, with hot keys."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import bitmaps, cost, selection, timeline


def queue(rows, idle):
    end, burst, out = {}, {}, {}
    for w, s, i, ms in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        burst[w] = burst.get(w, 0) + (w not in end or s > end[w] + idle)
        end[w] = max(s, end.get(w, s)) + ms
        out[i] = (end[w], burst[w])
    return out


@pytest.mark.parametrize("span", [400_000, 40_000_000])
def test_bursts_of_one_hot_warehouse(spark, span):
    rng = random.Random(span)
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else f"w{i % 3}", rng.randrange(span), i, rng.choice([0, 1, 500, 90_000])) for i in range(3000)]
    got = cost.bursts(spark.createDataFrame(rows, "w string, s long, id long, ms long"), "w", "s", "id", "ms", 60_000).collect()
    assert {r.id: (r.end_ms, r.burst) for r in got} == queue(rows, 60_000)


def test_a_hot_key_is_spread_over_ranges(spark):
    rows = spark.range(8000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 8000).alias("t"), "id")
    found = timeline.dealt(rows, ["k"], ["t", "id"], "test").groupBy("_range").count().collect()
    assert len(found) == 4 and max(r["count"] for r in found) < 4000


def test_values_are_carried_over_borders(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(400), i, f"v{i}" if rng.random() < 0.02 else None) for i in range(2000)]
    got = timeline.carried(spark.createDataFrame(rows, "k string, t int, id int, v string"), ["k"], ["t", "id"], "v", "last").collect()
    want, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        last[k] = v or last.get(k)
        want[i] = last[k]
    assert {r.id: r["last"] for r in got} == want
    assert "_range" not in timeline.carried(spark.createDataFrame([], "k string, t int, id int, v string"), ["k"], ["t", "id"], "v", "last").columns


def nearest(values, up, down):
    values = sorted(values, key=lambda x: (math.isnan(x), x))
    return values[max(1, -(-len(values) * up // down)) - 1] if values else None


VALUES = {
    "double": [*([3.5] * 40), *(1e300 * x for x in range(-30, 30)), math.inf, -math.inf, -0.0, 1e-308, *(x / 7 for x in range(90))],
    "long": [*([7] * 30), 2**63 - 1, -(2**63), *range(2**60, 2**60 + 60), *range(-50, 50)],
}


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)"])
def test_quantiles_are_exact(spark, kind):
    from decimal import Decimal

    rng = random.Random(11)
    values = VALUES.get(kind) or [Decimal(x) / 100 for x in range(-90, 200)]
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice(values)) for _ in range(1500)] + [("none", None), ("one", values[0]), ("one", None)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").cache()
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    for up, down in ((95, 100), (1, 2), (1, 1), (0, 1)):
        got = {r.g: r.v for r in selection.quantile(df, ["g"], "v", (up, down), width=8, few=3).collect()}
        assert got == {g: nearest(v, up, down) for g, v in groups.items()}
    whole = selection.quantile(df, [], "v", (95, 100), width=8, few=3).collect()
    assert [r.v for r in whole] == [nearest([v for _, v in rows if v is not None], 95, 100)]


def test_medians_are_exact(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.randrange(50)) for _ in range(400)] + [("c", 4), ("c", 9), ("d", None)]
    got = {r.g: r.v for r in selection.median(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", width=4, few=2).collect()}
    middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
    assert got == {g: middle(sorted(v for h, v in rows if h == g and v is not None)) for g in "abcd"}


def test_no_values(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert selection.quantile(empty, ["g"], "v", (1, 2)).collect() == []
    assert [r.v for r in selection.quantile(empty, [], "v", (1, 2)).collect()] == [None]


def test_bitmaps_roll_up_without_a_second_scan(spark, tmp_path):
    rng = random.Random(13)
    rows = [(rng.choice("xy"), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(70)), rng.choice([None, 0, -1, -40_000, 32_768, 32_769, *range(200)])) for _ in range(3000)]
    spark.createDataFrame(rows, "g string, d date, id long").write.parquet(str(tmp_path / "rows"))
    bitmaps.daily(spark.read.parquet(str(tmp_path / "rows")), ["g"], F.col("d"), "id").write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    months = bitmaps.rolled(days, ["g"], F.trunc("day", "month"))
    want = {}
    for g, d, i in rows:
        if i is not None:
            want.setdefault((g, d.replace(day=1)), set()).add(i)
    assert {(r.g, r.period): r.n for r in months.collect()} == {k: len(v) for k, v in want.items()}
    assert all("/days" in f for f in months.inputFiles())
