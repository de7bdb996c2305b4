"""Exact top-k inner products by MaxScore.

Components become integers, floor(256 x). A dimension is a term, and its posting list the column of a shard's
components in it (vectors are dense, so every list has all rows). Shards are about ``SHARD_ROWS`` rows; queries go to
every shard in blocks. For one query and shard each
term has a lowest and a highest possible contribution; what lies above the lowest is its bound. Terms are ranked by
bound. The essential terms are the fewest of highest bound such that the others' bounds sum to less than what
separates the threshold (the k-th best score so far) from the sum of the lowest contributions: a vector must score
on essential postings to compete. These are traversed for all vectors of the shard; the non-essential terms are
probed from high to low bound, only for vectors whose score so far plus the remaining bounds still reaches the
threshold, which rises as candidates are completed. The shards' lists are merged by rank.

All arithmetic is on integers, so results are exact and ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id; a query's own id is never its candidate; repeated rows are candidates each (one per row); of several query rows of
one id the least vector asks; scores are exact as long as they fit a long; vectors of another length than the query's have no product with it and are left out; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm._util import materialise, table

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 4096
BLOCK_BYTES = 16 << 20
PROBE_STEP = 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of longs) of the rows that take part."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(scale) * e.cast("double")))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    clean = vectors.where(fit & ~F.coalesce(bad, F.lit(True)))
    return clean.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def shard_top(ids: np.ndarray, v: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's best ``k`` (ids, scores) for one query; ``v`` has one row per dimension."""
    if not len(ids):
        return ids, ids
    low_high = np.stack([q * v.lows, q * v.highs])
    low, bound = low_high.min(axis=0), low_high.max(axis=0) - low_high.min(axis=0)
    order = np.argsort(-bound, kind="stable")
    rest = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # bounds of the terms from a place on
    base = int(low.sum())
    alive = np.flatnonzero(ids != query_id)
    seed = alive[:: max(1, len(alive) // (8 * k))]
    done = v.rows[seed] @ q
    theta = int(np.partition(done, -k)[-k]) if len(done) >= k else None
    essential = len(q) if theta is None else int(np.searchsorted(-rest, -(theta - base), side="right"))
    essential = min(max(essential, 1), len(q))
    part = v.rows[np.ix_(alive, order[:essential])] @ q[order[:essential]]
    at, left = essential, int(low[order[essential:]].sum())
    while at < len(q):
        if theta is not None:
            keep = part + left + rest[at] >= theta
            alive, part = alive[keep], part[keep]
        terms = order[at : at + PROBE_STEP]
        part = part + v.rows[np.ix_(alive, terms)] @ q[terms]
        at += len(terms)
        left = int(low[order[at:]].sum())
        if len(part) >= k:
            reached = int(np.partition(part, -k)[-k]) + left
            theta = reached if theta is None else max(theta, reached)
    best = np.lexsort((ids[alive], -part))[:k]
    return ids[alive][best], part[best]


class Shard:
    """A shard's vectors with each dimension's range."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.lows, self.highs = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (rows, rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``vectors`` for each of ``queries`` (vec_id, v).

    Vectors stay where they are: a partition's rows are its shards. The stated queries are dealt into blocks, and each
    block is sent to all partitions, ``BLOCK_BYTES`` at a time. What is shuffled are the shards' lists."""
    spark = vectors.sparkSession
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    rows = max(1, BLOCK_BYTES // (8 * max(1, size["d"] or 1)))
    blocks = max(1, -(-size["n"] // rows))
    lists = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()  # about BLOCK_BYTES
        asked = spark.sparkContext.broadcast([(int(i), np.asarray(v, dtype=np.int64)) for i, v in zip(mine["vec_id"], mine["v"], strict=True)])

        def search(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            for part in shards(batches):
                for length, group in part.groupby(part["v"].map(len)):
                    shard, ids = Shard(np.stack(group["v"].to_numpy())), group["vec_id"].to_numpy()
                    found = [(i, *shard_top(ids, shard, i, q, k)) for i, q in asked.value if len(q) == length and length]
                    if found:
                        n = [len(f[1]) for f in found]
                        yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], n), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

        part = vectors.mapInPandas(search, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
        part = materialise(part.select("query_id", "rank", "vec_id", "score"), "topk-lists")
        asked.unpersist()  # the next block takes its place
        lists = part if lists is None else lists.unionAll(part)
    return lists


def shards(batches: Iterator[pd.DataFrame], rows: int = SHARD_ROWS) -> Iterator[pd.DataFrame]:
    """Batches joined to shards of some rows: bounds and thresholds are worth more the more rows they stand for."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n >= rows:
            yield pd.concat(waiting)
            waiting, n = [], 0
    if n:
        yield pd.concat(waiting)


def op7_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(quantised(table(spark, sf_dir, "embeddings")), "topk-vectors")
    queries = vectors.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(vectors, queries)


OP7_SQL = f"""
WITH fit AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
