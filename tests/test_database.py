"""Reads of a database by counted key ranges, against the rows themselves."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import database

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k long, at timestamp_ntz, note string"


def keys(kind, n=3000):
    rng = random.Random(n)
    if kind == "dense":
        return list(range(n))
    if kind == "skewed":  # nearly all keys in a tiny part of their range
        return [*range(n - 40), *(10**12 + x * 10**10 for x in range(39)), -(10**15)]
    return [rng.randrange(50) for _ in range(n - 700)] + [7] * 700  # repeated


@pytest.mark.parametrize("kind", ["dense", "skewed", "repeated"])
def test_partitions_read_their_own_counted_ranges(spark, kind):
    rows = [(k, T0 + dt.timedelta(minutes=i % 1000), f"n{i}") for i, k in enumerate(keys(kind))] + [(None, T0 + dt.timedelta(minutes=5), "no key"), (3, None, "no time")]
    db = database.embedded("ranges")
    db.write(spark.createDataFrame(rows, SCHEMA), kind)
    got = database.changed_rows(db, spark, kind, "k", "at", "2024-01-01 00:01:00", "2024-01-01 10:00:00", parts=6)
    want = [r for r in rows if r[1] and T0 + dt.timedelta(minutes=1) < r[1] <= T0 + dt.timedelta(hours=10)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    each = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    ranges = sorted((r.lo, r.hi, r.n) for r in each if r.lo is not None)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and len(ranges) >= 5
    if kind != "repeated":
        assert max(r[2] for r in ranges) <= -(-len(want) // 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(at), *LessThanOrEqual(at" in plan and "Exchange" not in plan


def test_no_rows(spark):
    db = database.embedded("ranges")
    db.write(spark.createDataFrame([], SCHEMA), "empty")
    assert database.changed_rows(db, spark, "empty", "k", "at", None, "2024-01-01 10:00:00").collect() == []
    db.write(spark.createDataFrame([(None, T0, "x")], SCHEMA), "nokey")
    assert database.changed_rows(db, spark, "nokey", "k", "at", None, "2024-01-01 10:00:00").count() == 1


def test_a_published_table_is_read_by_other_processes(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(seconds=k, microseconds=k), note) for k, note in enumerate(['a "quoted", b', "two\nlines", "", None, "é \\", "plain"] * 40)] + [(None, T0, None), (900, None, "x")]
    db = database.published(spark.createDataFrame(rows, SCHEMA), "notes")
    got = database.changed_rows(db, spark, "notes", "k", "at", None, "2024-02-01 00:00:00")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[1]), key=str)
    code = (
        "import sys; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local-cluster[2,1,1024]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"from lakeloom.sources import database as d; db = d.Database({db.url!r}, {db.options!r})\n"
        "print('ROWS', d.changed_rows(db, s, 'notes', 'k', 'at', None, '2024-02-01 00:00:00').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=Path(database.__file__).parents[2])
    assert f"ROWS {len(rows) - 1}" in done.stdout, done.stderr[-2000:]  # while this process has it open
