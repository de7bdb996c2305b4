"""Single faults: what they hit is what their truth says, and repair undoes them."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import faults
from lakeloom.operators.faults import OneOff

FAULTS = [OneOff("a", "invented", 3), OneOff("b", "deleted", 4), OneOff("c", "changed", 5, "v", "concat({c}, '!')"), OneOff("d", "changed", 2, "m", "{c} + 0.01"), OneOff("e", "changed", 50, "w", "upper({c})")]


@pytest.mark.parametrize("fault", FAULTS, ids=lambda f: f.name)
def test_a_fault_is_its_truth_and_can_be_repaired(spark, fault):
    source = spark.range(1, 200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.col("id").cast("decimal(12,2)").alias("m"), F.when(F.col("id") < 4, F.lit("w")).alias("w"))
    damaged, truth = faults.planted(source, "k", fault, 7)
    assert damaged.schema == source.schema
    before, after, told = ({tuple(r) for r in x.collect()} for x in (source, damaged, truth))
    hit = {int(r[0]) for r in told}
    assert {r[0] for r in before ^ after} == hit
    assert len(hit) == (3 if fault.name in "ae" else fault.rows)  # of the last, only rows with a value
    if fault.kind == "invented":
        assert min(hit) > 1_000_199 and not hit & {r[0] for r in before}
    assert {tuple(r) for r in faults.repaired(damaged, source, "k", truth).collect()} == before
    assert hit == {int(r.row_key) for r in faults.planted(source.repartition(7), "k", fault, 7)[1].collect()}


def test_an_empty_copy_has_no_faults(spark):
    empty = spark.createDataFrame([], "k long, v string")
    for fault in (OneOff("a", "invented", 3), OneOff("b", "deleted", 4), OneOff("c", "changed", 5, "v", "'x'")):
        damaged, truth = faults.planted(empty, "k", fault, 7)
        assert damaged.collect() == [] and truth.collect() == []
