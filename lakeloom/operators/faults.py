"""Single faults planted in a copy of a table, told apart from each other by their truth, and repaired from the source.

Which rows a fault hits follows from a hash of seed, fault and key, so the same are hit wherever it is planted; they are
the least by that hash, found without sorting the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.sources.tables import hashed

#: How far above the largest key invented rows begin, so that the next real keys are not theirs.
APART = 1_000_000


@dataclass(frozen=True)
class OneOff:
    """``kind``: invented (copies of rows under new keys), deleted, or changed (``column`` becomes ``change``, an
    expression in which {c} is the column)."""

    name: str
    kind: str
    rows: int
    column: str = ""
    change: str = ""


def chosen(copy: DataFrame, key: str, fault: OneOff, seed: int) -> DataFrame:
    """The keys that a fault hits, of rows whose column holds a value."""
    live = copy.where(F.col(fault.column or key).isNotNull()).select(key)
    salted = live.withColumn("_fault", F.lit(fault.name))
    return salted.orderBy(hashed(seed, "_fault", key), key).limit(fault.rows).select(key)


def planted(copy: DataFrame, key: str, fault: OneOff, seed: int) -> tuple[DataFrame, DataFrame]:
    """The damaged copy, and its truth: row_key, column_name, kind."""
    if fault.kind == "invented":
        first = copy.orderBy(key).limit(fault.rows).withColumn("_n", F.row_number().over(W.orderBy(key)))  # these few rows
        top = F.broadcast(copy.agg(F.max(key).alias("_top")))  # one row
        fresh = first.crossJoin(top).withColumn(key, F.coalesce("_top", F.lit(0)) + APART + F.col("_n")).select(*copy.columns)
        hit, damaged = fresh.select(key), copy.unionByName(fresh)
    else:
        hit = chosen(copy, key, fault, seed)
        few = F.broadcast(hit.withColumnRenamed(key, "_hit"))  # as many rows as the fault has
        if fault.kind == "deleted":
            damaged = copy.join(few, copy[key] == few["_hit"], "left_anti")
        else:
            new = F.expr(fault.change.format(c=fault.column)).cast(copy.schema[fault.column].dataType)
            marked = copy.join(few, copy[key] == few["_hit"], "left")
            damaged = marked.withColumn(fault.column, F.when(F.col("_hit").isNotNull(), new).otherwise(F.col(fault.column))).drop("_hit")
    return damaged, hit.select(F.col(key).cast("string").alias("row_key"), F.lit(fault.column).alias("column_name"), F.lit(fault.kind).alias("kind"))


def repaired(damaged: DataFrame, source: DataFrame, key: str, truth: DataFrame) -> DataFrame:
    """The copy with the rows that a fault hit loaded from the source again; invented ones are gone."""
    hit = F.broadcast(truth.select(F.col("row_key").alias("_hit")))
    same = lambda rows: rows[key].cast("string") == hit["_hit"]
    return damaged.join(hit, same(damaged), "left_anti").unionByName(source.join(hit, same(source), "left_semi"))
