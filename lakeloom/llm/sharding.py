"""Shards of nearly equal bytes by histogram sort.

Every row gets a 64-bit sort key: 32 bits of its text's hash, then 32 bits of its own hash, so equal texts lie side
by side. Splitters are found by counting: the exact bytes below evenly spaced candidate keys (probes) are counted
over all partitions; a splitter whose byte count is within the tolerance of its target is fixed, every other one
is probed again inside the one probe interval that holds it. At most ``shards - 1`` intervals of ``2**12`` probes
are open per round, whatever the table holds, and six rounds reach single keys. Because text bits come first, a
splitter prefers a border between groups of equal texts, and cuts a group only if the tolerance demands it. Then
the rows are exchanged once, by ranges finer than the shards (so that more machines shorten the sort), and numbered.

Only DataFrame expressions are used. Defined results: a null text counts as empty (size 1, crc32 0); a null
``doc_id`` is kept; repeated rows are placed each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm._util import materialise, partitions, table, whole_text

SHARDS = 16
TOLERANCE = 0.001
#: Key bits left of which a round's probes stand: 12 more bits a round, with a stop where the text's bits end.
SHIFTS = (52, 40, 32, 20, 8, 0)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key _k of every row, written once (texts are not carried further)."""
    text, own = whole_text(), F.monotonically_increasing_id()
    key = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), own), 32))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("_k"),
    )


def splitters(rows: DataFrame, weight: Column, parts: int, tolerance: float) -> list[int]:
    """Keys that cut the sorted rows into ``parts`` ranges of equal weight; a range holds keys >= its splitter."""
    total = rows.agg(F.sum(weight)).first()[0] or 0
    found: list[int] = []
    wanted = {None: [(total * i // parts) for i in range(1, parts)]} if total else {}  # open interval: its targets
    below = {None: 0}  # weight below an open interval
    for shift, above in zip(SHIFTS, (64, *SHIFTS), strict=False):
        if not wanted:
            break
        probe = F.shiftright("_k", shift) if shift else F.col("_k")
        inside = rows if None in wanted else rows.where(F.shiftright("_k", above).isin(list(wanted)))
        counted = inside.groupBy(probe.alias("probe")).agg(F.sum(weight).alias("w")).collect()  # <= 2**12 a target
        nodes: dict[int | None, list[tuple[int, int]]] = {}
        for r in sorted(counted):
            nodes.setdefault(None if None in wanted else r["probe"] >> (above - shift), []).append((r["probe"], r["w"]))
        still: dict[int | None, list[int]] = {}
        under: dict[int | None, int] = {}
        for node, targets in wanted.items():
            probes = nodes[node]
            ends, at = [], below[node]
            for _, w in probes:
                at += w
                ends.append(at)
            for target in targets:
                j = min(bisect.bisect_right(ends, target), len(ends) - 1)
                start = ends[j] - probes[j][1]
                low, high = target - start, ends[j] - target
                if min(low, high) <= tolerance * total / parts or not shift:
                    found.append((probes[j][0] + (high < low)) << shift)
                else:
                    still.setdefault(probes[j][0], []).append(target)
                    under[probes[j][0]] = start
        wanted, below = still, under
    return sorted(min(k, (1 << 63) - 1) for k in found)


def position(key: Column, borders: Sequence[int], spark: SparkSession) -> tuple[DataFrame, Column]:
    """A table of 2**12 rows that says how many borders lie below each key prefix, and the count for a key."""
    rows = []
    for p in range(-(1 << 11), 1 << 11):
        lo, hi = bisect.bisect_right(borders, p << SHIFTS[0]), bisect.bisect_left(borders, (p + 1) << SHIFTS[0])
        rows.append((p, lo, list(borders[lo:hi])))
    lookup = spark.createDataFrame(rows, "_p long, _base int, _inner array<long>")
    return lookup, F.col("_base") + F.size(F.filter("_inner", lambda b: b <= key))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (always null: the law is ``bytes``)."""
    spark = docs.sparkSession
    rows = materialise(keyed(docs), "shard-keys")
    cuts = splitters(rows, F.col("size"), shards, tolerance)
    ranges = splitters(rows, F.lit(1), max(64, partitions(spark)), 0.5)
    borders = sorted({*cuts, *ranges})
    lookup, leaf = position(F.col("_k"), borders, spark)
    placed = rows.withColumn("_p", F.shiftright("_k", SHIFTS[0])).join(F.broadcast(lookup), "_p").withColumn("_leaf", leaf)
    counts = dict(map(tuple, placed.groupBy("_leaf").count().collect()))  # one row a range
    shard_of, start_of, filled = [], [], [0] * (shards + 1)
    for i in range(len(borders) + 1):
        shard = bisect.bisect_right(cuts, borders[i - 1]) if i else 0
        shard_of.append(shard)
        start_of.append(filled[shard])
        filled[shard] += counts.get(i, 0)
    ranges_table = spark.createDataFrame(list(zip(range(len(shard_of)), shard_of, start_of, strict=True)), "_leaf int, shard int, _start long")
    own = F.row_number().over(W.partitionBy("_leaf").orderBy("_k", "doc_id"))
    return (
        placed.withColumn("_own", own)
        .join(F.broadcast(ranges_table), "_leaf")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_start") + F.col("_own") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
