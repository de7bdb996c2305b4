"""Versions of tables under readers and other writers; bucketed plans; the order of a build."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakeloom.plans.build import build, largest_first
from lakeloom.sources import bucketed
from lakeloom.sources.versioned import Conflict, Versions


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_readers_keep_their_version(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.snapshot().version == 0
    reader = versions.commit(replace={"a": spark.range(5), "b": spark.range(2)})
    open_rows = reader.table("a")
    versions.commit(replace={"a": spark.range(7, 9)}, append={"b": spark.range(2, 4)})
    versions.commit(append={"a": spark.range(9, 10)})
    versions.compact("a", lambda rows: rows.where("id <> 8"))
    assert ids(open_rows) == [0, 1, 2, 3, 4] and ids(reader.table("b")) == [0, 1]
    now = versions.snapshot()
    assert ids(now.table("a")) == [7, 9] and ids(now.table("b")) == [0, 1, 2, 3] and now.version == 4
    assert ids(versions.snapshot(3).table("a")) == [7, 8, 9]
    gone = versions.vacuum(keep=1)
    assert len(gone) == 3 and versions.numbers() == [4] and ids(versions.snapshot().table("a")) == [7, 9]
    assert versions.commit(drop=["a"]).tables.keys() == {"b"}


def test_writers_do_not_lose_each_other(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    base = versions.commit(replace={"a": spark.range(1), "b": spark.range(1)})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: versions.commit(append={"a": spark.range(k, k + 1)}), range(10, 16)))
    assert ids(versions.snapshot().table("a")) == [0, *range(10, 16)] and versions.numbers() == list(range(1, 8))
    with pytest.raises(Conflict):
        versions.commit(replace={"a": spark.range(3)}, base=base)
    assert ids(versions.commit(replace={"b": spark.range(3)}, base=base).table("b")) == [0, 1, 2]
    assert not versions._publish(2, {})  # a number is taken once


def test_a_failed_write_is_no_version(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    versions.commit(replace={"a": spark.range(3)})
    with pytest.raises(Exception, match="broken"):
        versions.commit(replace={"a": spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))})
    with pytest.raises(ValueError, match="columns"):
        versions.commit(append={"a": spark.range(2).withColumn("more", F.lit(1))})
    assert versions.numbers() == [1] and ids(versions.snapshot().table("a")) == [0, 1, 2]
    assert ids(versions.commit(replace={"none": spark.range(0)}).table("none")) == []


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id", (F.col("id") * 7 % 13).alias("v"))
    one, two = (bucketed.bucketed(rows, name, "k", ["id"], 4) for name in ("one", "two"))
    latest = bucketed.newest(one, "k", ["id"])
    assert {r.k: r.id for r in latest.collect()} == {k: 950 + k for k in range(50)}
    both = latest.hint("merge").join(two.groupBy("k").agg(F.sum("v").alias("s")), "k")
    assert "Exchange" not in plan(latest) and "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    assert both.count() == 50


def test_the_largest_models_are_begun_first_in_pools_of_their_own(spark, tmp_path):
    sf, names = "/root/testdata/sf0.001", ["stg_marketing_campaigns", "stg_orders", "stg_products", "stg_order_items"]
    build(spark, sf, str(tmp_path), names, threads=2)
    order = largest_first(spark, sf, str(tmp_path), names)
    assert order[:2] == ["stg_order_items", "stg_orders"] and order[-1] == "stg_marketing_campaigns"
    again = build(spark, sf, str(tmp_path), names, threads=1)
    assert [n for n, _ in again.started] == order and {p for _, p in again.started} == {"build-0"}
