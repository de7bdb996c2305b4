"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints: words are runs of anything but ASCII white space, A-Z lower-cased; the XXH64 (seed 42) of each
shingle votes on 64 bits. Equal fingerprints are one node, so copies cost one comparison.

Search: two fingerprints that differ in at most 3 bits agree in one of four 16-bit blocks, so each is filed under
its four blocks and only rows of one bucket can link. Buckets larger than ``SPLIT_OVER`` are filed again by the
four quarters of their remaining bits, and so on until none is large or six bits are left (``LEVELS``), so a large
group of near copies is dealt out instead of meeting in one task; nothing is left out. Within a bucket the index sorts the fingerprints by Gray
rank, where neighbours share long bit patterns, and factors the bits shared by ``FANOUT`` neighbours into a node
(mask and pattern), the bits shared by ``FANOUT`` nodes into a node above, and so on. A search walks down from
the top, adds up the differences on each node's newly fixed bits, and drops a whole group once they exceed 3.

From each bucket come at most (members - 1) links, a spanning forest of the links found there. Components follow
by hooking to smaller labels and pointer jumping over those links, written to the shared folder after each round.

Defined results: a null or empty text, or one of white space only, has the fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows are kept each; rows with a null
``doc_id`` are compared, and are labelled null only where no member of the component has an id; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import discard, id_text, materialise, table, whole_text

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
FANOUT = 16
SPLIT_OVER = 512
LEVELS = 8
PAIRS_AT_ONCE = 1_000_000

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The hash of each shingle of a whole text, in order; none for a text without words."""
    found = WORDS.findall(text.encode().lower())  # bytes.lower() changes A-Z only
    if not found:
        return np.array([], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    joined, n = b" ".join(found), len(found)
    first = [0, *ends[: max(0, n - shingle)].tolist()] if n > shingle else [0]
    last = (ends[shingle - 1 :] - 1).tolist() if n > shingle else [len(joined)]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, first, last)), repeat(SEED)), np.uint64, len(first))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and _fp (the fingerprint's bits as a signed long). Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "_fp": found.view(np.int64)})

    source = docs.select(id_text().alias("doc_id"), whole_text().alias("text"))
    return source.mapInPandas(run, "doc_id string, _fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over several buckets; a bucket is a run of equal numbers in ``bucket``."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes, self.bucket = codes[order], bucket[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child, from leaves up
        mask, pattern, owner = np.full(len(codes), ~np.uint64(0)), self.codes, self.bucket
        while True:
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], dtype=int)
            run = np.diff(np.r_[start, len(owner)])
            if not len(owner) or run.max() == 1:
                break
            inside = np.arange(len(owner)) - np.repeat(start, run)
            first = np.flatnonzero(inside % fanout == 0)
            every = np.bitwise_and.reduceat(pattern, first)
            some = np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
            self.levels.append((mask, pattern, first))
            mask, pattern, owner = shared, every & shared, owner[first]
        self.top = (mask, pattern, owner)

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (smaller first) that differ in at most ``radius`` bits, in blocks."""
        mask, pattern, owner = self.top
        root = np.searchsorted(owner, self.bucket)  # one node a bucket is left at the top
        alone = np.bincount(root, minlength=len(owner))
        searching = np.flatnonzero(alone[root] > 1)
        stack = []
        step = max(1, PAIRS_AT_ONCE // FANOUT)
        for lo in range(0, len(searching), step):
            q = searching[lo : lo + step]
            node = root[q]
            stack.append((len(self.levels), q, node, np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node]).astype(np.uint8)))
        while stack:
            level, q, node, differ = stack.pop()
            keep = differ <= radius
            q, node, differ = q[keep], node[keep], differ[keep]
            if not level:
                keep = q < node
                if keep.any():
                    yield q[keep], node[keep]
                continue
            upper = self.top[:2] if level == len(self.levels) else self.levels[level][:2]
            mask, pattern, first = self.levels[level - 1]
            children = np.diff(np.r_[first, len(mask)])
            for lo in range(0, len(q), step):
                n = children[node[lo : lo + step]]
                at = np.repeat(np.arange(lo, lo + len(n)), n)
                child = first[node[at]] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                fresh = mask[child] & ~upper[0][node[at]]  # bits that the node above has not counted
                more = np.bitwise_count((self.codes[q[at]] ^ pattern[child]) & fresh).astype(np.uint8)
                stack.append((level - 1, q[at], child, differ[at] + more))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked position of each of ``n`` positions."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def bucket_links(keys: list[np.ndarray], codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger member) of a spanning forest in each bucket."""
    _, bucket = np.unique(np.stack(keys), axis=1, return_inverse=True) if len(codes) else (None, np.array([], dtype=int))
    index = GrayIndex(bucket.reshape(-1), codes)
    label = forest(len(codes), index.within(radius))
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[label[linked]], index.codes[linked]


def filed(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its four 16-bit blocks: _bucket, _free (a mask of the bits not yet used), _fp."""
    blocks = [F.struct(F.lit(b).alias("b"), F.lit(~(0xFFFF << 16 * b) if b < 3 else 0xFFFFFFFFFFFF).cast("long").alias("f")) for b in range(4)]
    rows = nodes.select("_fp", F.explode(F.array(*blocks)).alias("_x"))
    used = F.col("_fp").bitwiseAND(F.bitwise_not("_x.f"))
    return rows.select(F.xxhash64(F.col("_x.b"), used).alias("_bucket"), F.col("_x.f").alias("_free"), "_fp")


def refiled(rows: DataFrame) -> DataFrame:
    """The rows of large buckets, filed again by the four quarters of their free bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for free, part in batch.groupby("_free"):
                places = [i for i in range(BITS) if free >> i & 1]
                for k in range(4):
                    quarter = sum(1 << i for i in places[k * len(places) // 4 : (k + 1) * len(places) // 4])
                    left = int(np.array(int(free) & ((1 << 64) - 1) & ~quarter, dtype=np.uint64).view(np.int64))
                    used = part["_fp"].to_numpy().view(np.uint64) & np.uint64(quarter)
                    mixed = (used ^ np.uint64(quarter)) * np.uint64(0x9E3779B97F4A7C15)
                    own = part["_bucket"].to_numpy().view(np.uint64)
                    key = (own ^ (mixed >> np.uint64(29)) ^ mixed) * np.uint64(0xBF58476D1CE4E5B9)
                    out.append(pd.DataFrame({"_bucket": key.view(np.int64), "_free": left, "_fp": part["_fp"].to_numpy()}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, "_bucket long, _free long, _fp long")


def links(nodes: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER, levels: int = LEVELS) -> DataFrame:
    """Links _a, _b of distinct fingerprints; their components are those of all pairs within ``radius``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            part = pd.concat(waiting) if waiting else None
            if part is not None and len(part) > 1:
                a, b = bucket_links([part["_bucket"].to_numpy(), part["_free"].to_numpy()], part["_fp"].to_numpy().view(np.uint64), radius)
                if len(a):
                    yield pd.DataFrame({"_a": a.view(np.int64), "_b": b.view(np.int64)})

        for batch in batches:  # sorted by bucket; the last one of a batch may go on in the next
            if not len(batch):
                continue
            ends = batch["_bucket"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])[-1])  # where the last bucket begins
            if cut:
                waiting.append(batch.iloc[:cut])
                yield from flush()
                waiting = [batch.iloc[cut:]]
            else:
                if waiting and waiting[-1]["_bucket"].iloc[-1] != ends[0]:
                    yield from flush()
                    waiting = []
                waiting.append(batch)
        yield from flush()

    def search(rows: DataFrame) -> DataFrame:
        return rows.repartition("_bucket").sortWithinPartitions("_bucket").mapInPandas(run, "_a long, _b long")

    rows, found = materialise(filed(nodes), "simhash-filed"), []
    for level in range(levels):
        large = rows.groupBy("_bucket").count().where(F.col("count") > split_over).select("_bucket")
        large = materialise(large, "simhash-large")
        if level == levels - 1 or large.isEmpty():
            break
        found.append(search(rows.join(large, "_bucket", "left_anti")))
        rows = materialise(refiled(rows.join(large, "_bucket", "left_semi")), "simhash-filed")
    found.append(search(rows))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return materialise(out.distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """_fp and _root (one member) of every node that has a link. Each round hooks roots to smaller neighbouring
    roots and halves paths; the number of rounds grows with the logarithm of the longest path."""
    both = edges.unionAll(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    label = materialise(both.groupBy(F.col("_a").alias("_fp")).agg(F.min("_b").alias("_n")).select("_fp", F.least("_fp", "_n").alias("_root")), "simhash-labels")
    while True:
        a, b = (label.select(F.col("_fp").alias(c), F.col("_root").alias(f"_r{c}")) for c in ("_a", "_b"))
        seen = edges.join(a, "_a").join(b, "_b").where(F.col("_r_a") != F.col("_r_b"))
        hook = seen.select(F.greatest("_r_a", "_r_b").alias("_fp"), F.least("_r_a", "_r_b").alias("_to"))
        hook = materialise(hook.groupBy("_fp").agg(F.min("_to").alias("_to")), "simhash-hooks")
        up = label.join(hook, "_fp", "left").select("_fp", F.least("_root", F.coalesce("_to", "_root")).alias("_root"))
        above = up.select(F.col("_fp").alias("_root"), F.col("_root").alias("_over"))
        label2 = up.join(above, "_root").select("_fp", F.col("_over").alias("_root"))
        settled = hook.isEmpty()
        old, label = label, label if settled else materialise(label2, "simhash-labels")
        discard(hook, *([] if settled else [old]))
        if settled:
            return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = materialise(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"))
    nodes = materialise(nodes, "simhash-nodes")
    root = components(links(nodes.select("_fp"), radius))
    owned = nodes.join(root, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = owned.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = owned.join(least, "_root").select("_fp", "component_id")
    return prints.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, least: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text hash (_id, _h) are in ``least``, of equal rows one; ``rows`` holds _id and
    _h of every row. The keys are values of the row, so they mean the same in every reading."""
    same = lambda a, b: a["_h"].eqNullSafe(b["_h"]) & a["_id"].eqNullSafe(b["_id"])
    many = rows.groupBy("_id", "_h").agg((F.count(F.lit(1)) > 1).alias("_many"))
    kept = materialise(many.join(least, same(many, least), "left_semi"), "simhash-kept")
    keyed = docs.withColumn("_keep_id", F.col("doc_id").cast("long")).withColumn("_keep_h", F.xxhash64(whole_text()))

    def held(part: DataFrame) -> DataFrame:
        part = part.hint("merge")  # one plan at every size
        here = keyed["_keep_h"].eqNullSafe(part["_h"]) & keyed["_keep_id"].eqNullSafe(part["_id"])
        return keyed.join(part, here, "left_semi")

    out = held(kept.where(~F.col("_many")))
    if not kept.where("_many").isEmpty():
        out = out.unionAll(held(kept.where("_many")).dropDuplicates(["_keep_id", "_keep_h"]))
    return out.drop("_keep_id", "_keep_h")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that of the smallest ``doc_id``, of rows that share it the one of least text
    hash, of equal rows one. All joins are by values of the row (its id and text hash), none by its place."""
    ids = materialise(docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_h")), "simhash-ids")
    prints = fingerprints(docs.select(F.xxhash64(whole_text()).alias("doc_id"), "text"), shingle)
    prints = materialise(prints.select(F.col("doc_id").alias("_h"), "_fp").distinct(), "simhash-prints")
    rank = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_h").alias("h"))
    texts = ids.groupBy("_h").agg(F.min(rank).alias("_least")).join(prints, "_h")
    nodes = materialise(texts.groupBy("_fp").agg(F.min("_least").alias("_least")), "simhash-nodes")
    root = components(links(nodes.select("_fp"), radius))
    owned = nodes.join(root, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = owned.groupBy("_root").agg(F.min("_least").alias("_least")).select(F.col("_least.i").alias("_id"), F.col("_least.h").alias("_h"))
    return keep_least(docs, least, ids)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
