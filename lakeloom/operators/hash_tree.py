"""A table's hash tree, kept from night to night.

Leaves sum the hashes of the rows in a key bucket, every level above sums sixteen segments of the level below, down to
one root. The tree and each row's own hash are tables in files, so the next night hashes only rows that changed: their
old hashes leave the sums, their new ones enter, and only the files that hold their keys are written again. Two nights,
or two systems, are compared by their roots, then by their leaves, then by the hashes below differing leaves; no row of
the tables themselves is read.

Keys are unique; hash sums are exact decimals, so subtracting undoes adding."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.reconcile import FANOUT_BITS, Rule, hashed
from lakeloom.session import stored
from lakeloom.sources.tables import file_system

DEPTH = 4
#: Row hashes lie in a folder for each segment of this depth, if no other is named; a night writes those of its changes
#: again.
PARTS_DEPTH = 2
ROW = "row_key string, bucket long, h1 long, h2 long"


@dataclass(frozen=True)
class Tree:
    """One night: where the sums (level, segment, n_rows, h1, h2) and the row hashes of each part are, and how many rows
    were hashed to make it. Nights share the folders of parts that did not change."""

    spark: SparkSession
    folder: str
    sums: str
    parts: Mapping[int, str]
    n_hashed: int
    parts_depth: int = PARTS_DEPTH

    def levels(self) -> DataFrame:
        return self.spark.read.parquet(self.sums)

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame:
        paths = [path for part, path in self.parts.items() if parts is None or part in parts]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)


def segment(depth: int) -> Column:
    return F.shiftright("bucket", 32 - FANOUT_BITS * depth)


def leaves(rows: DataFrame, sign: int = 1) -> DataFrame:
    """segment, n_rows, h1, h2: what rows add to (or take from) the leaves."""
    total = lambda c: (sign * F.sum(F.col(c).cast("decimal(38,0)"))).cast("decimal(38,0)").alias(c)
    return rows.groupBy(segment(DEPTH).alias("segment")).agg((sign * F.count(F.lit(1))).cast("long").alias("n_rows"), total("h1"), total("h2"))


def summed(parts: DataFrame) -> DataFrame:
    """Sums by level and segment; what has no rows left is gone."""
    total = lambda c, kind: F.sum(c).cast(kind).alias(c)
    big = "decimal(38,0)"
    return parts.groupBy("level", "segment").agg(total("n_rows", "long"), total("h1", big), total("h2", big)).where("n_rows <> 0")


def levels_over(leaf: DataFrame) -> DataFrame:
    """The leaves under every level: each counts in the segment over it."""
    over = [F.struct(F.lit(d).alias("level"), F.shiftright("segment", FANOUT_BITS * (DEPTH - d)).alias("segment")) for d in range(DEPTH + 1)]
    return leaf.select(F.explode(F.array(*over)).alias("s"), "n_rows", "h1", "h2").select("s.level", "s.segment", "n_rows", "h1", "h2")


def write_parts(rows: DataFrame, folder: str, depth: int) -> dict[int, str]:
    """Row hashes in a folder for each part; part: folder, 16 ** depth of them at most."""
    spark, path = rows.sparkSession, f"{folder}/rows-{uuid.uuid4().hex}"
    rows.withColumn("part", segment(depth).cast("int")).repartition("part").write.partitionBy("part").parquet(path)
    fs, p = file_system(spark, path)
    names = [str(s.getPath().getName()) for s in fs.listStatus(p)]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith("part=")}


def written(sums: DataFrame, folder: str) -> str:
    path = f"{folder}/sums-{uuid.uuid4().hex}"
    sums.repartition("level").sortWithinPartitions("level", "segment").write.parquet(path)
    return path


def keyed(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Rule]) -> DataFrame:
    return hashed(rows, key, rules).select("row_key", "bucket", "h1", "h2")


def build(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Rule], folder: str, parts_depth: int = PARTS_DEPTH) -> Tree:
    """The tree of a whole table: every row is hashed."""
    fresh = stored(keyed(rows, key, rules), "hash-rows")
    return Tree(rows.sparkSession, folder, written(summed(levels_over(leaves(fresh))), folder), write_parts(fresh, folder, parts_depth), fresh.count(), parts_depth)


def advance(tree: Tree, changed: DataFrame, gone: DataFrame, key: Sequence[str], rules: Mapping[str, Rule]) -> Tree:
    """The next night's tree, from rows that are new or different and keys (columns ``key``) that are gone."""
    fresh = stored(keyed(changed, key, rules), "hash-rows")
    leaving = keyed(gone.select(*key), key, {k: rules[k] for k in key}).unionAll(fresh).select("row_key", "bucket")
    leaving = stored(leaving.distinct(), "hash-keys")
    touched = [r["p"] for r in leaving.select(segment(tree.parts_depth).cast("int").alias("p")).distinct().collect()]  # as many as parts at most
    here = tree.rows(touched)
    old = here.join(leaving.select("row_key"), "row_key", "left_semi")
    delta = levels_over(leaves(fresh).unionAll(leaves(old, -1))).withColumn("level", F.col("level").cast("int"))
    sums = summed(tree.levels().select(delta.columns).unionAll(delta))
    kept = here.join(leaving.select("row_key"), "row_key", "left_anti").select("row_key", "bucket", "h1", "h2").unionAll(fresh)
    parts = {p: path for p, path in tree.parts.items() if p not in touched} | write_parts(kept, tree.folder, tree.parts_depth)
    return Tree(tree.spark, tree.folder, written(sums, tree.folder), parts, fresh.count(), tree.parts_depth)


def differing(a: Tree, b: Tree) -> DataFrame:
    """row_key and kind (missing in b, extra in b, changed) of the rows that differ."""
    same = (F.col("n_rows") == F.col("m_rows")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))

    def unlike(level: int) -> DataFrame:
        other = b.levels().where(F.col("level") == level).select("segment", F.col("n_rows").alias("m_rows"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        return a.levels().where(F.col("level") == level).join(other, "segment", "full").where(~F.coalesce(same, F.lit(False))).select("segment")

    inside = a.spark.createDataFrame([], "segment long") if unlike(0).isEmpty() else stored(unlike(DEPTH), "hash-segments")

    def below(x: Tree) -> DataFrame:
        up = FANOUT_BITS * (DEPTH - x.parts_depth)
        return x.rows([r["p"] for r in inside.select(F.shiftright("segment", up).cast("int").alias("p")).distinct().collect()])

    left, right = (below(x).join(inside, segment(DEPTH) == inside["segment"], "left_semi") for x in (a, b))
    both = left.alias("a").join(right.alias("b"), "row_key", "full")
    kind = F.when(F.col("b.h1").isNull(), "missing").when(F.col("a.h1").isNull(), "extra").when((F.col("a.h1") != F.col("b.h1")) | (F.col("a.h2") != F.col("b.h2")), "changed")
    return both.select("row_key", kind.alias("kind")).where(F.col("kind").isNotNull())
