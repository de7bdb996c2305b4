"""Near duplicates by SimHash and by the similarity of their shingles, for the pipeline.

Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; words
are those of the fingerprints (``simhash.WORDS``, A-Z lower-cased). Texts whose fingerprints differ in at most three
bits, directly or over others (``simhash``, with its search), are candidates, and every two of such a group are checked.
At 0.8 two 64-bit fingerprints differ in about 10 bits and often in 15, and no blocks of 64 bits are selective for
that, so further candidates come from ``BANDS`` bands
of ``ROWS`` least hashes: a pair of exactly 0.8 shares none with a chance of 2 in 100,000, one of 0.85 of 8 in
10^8. Every candidate is then checked by its whole sets of shingles.

Equal sets are one node. A bucket's members are checked against a few of them, and what is left of it in blocks
(``linked``), so components are those of all candidate pairs, and no list of pairs is ever made. All tables are keyed by stored values or values of the text alone, so a changed scan layout cannot
change the result.

Defined results: texts without words are one group; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import simhash
from lakeloom.llm._util import discard, id_text, materialise, release, whole_text
from lakeloom.llm.simhash import components, keep_least, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 28, 5
CENTRES = 4
BLOCK, COLUMNS = 256, 1 << 14
SEED = 42
AT_ONCE = 4096
TEXTS_AT_ONCE = 512

_RANDOM = np.random.default_rng(SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def bands(found: np.ndarray) -> list[int]:
    """One signed number a band: a hash of its least hashes. Without shingles all bands are equal."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    step = max(1, AT_ONCE // 16)
    for lo in range(0, len(found), step):
        least = np.minimum(least, ((found[None, lo : lo + step] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) - (1 << 63) for b in range(BANDS)]


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_id, _h (hash of the text), _n (hash of its set of shingles), _size, _bands and _fp (fingerprint) of every row. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:  # one set at a time
                own = shingles(t, shingle)
                found.append((node(own), len(own), bands(own), simhash.fingerprint(t)))
            n, size, keys, prints = zip(*found, strict=True) if found else ((), (), (), ())
            prints = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_id": batch["_id"], "_h": batch["_h"].to_numpy(), "_n": n, "_size": size, "_bands": keys, "_fp": prints})
        release()

    source = docs.select(id_text().alias("_id"), F.xxhash64(whole_text()).alias("_h"), whole_text().alias("text"))
    return source.mapInPandas(run, "_id string, _h long, _n long, _size long, _bands array<long>, _fp long").withColumn("_id", F.col("_id").cast("long"))


def node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_n and _set of the rows with the id ``_i`` and the text hash ``_h`` in ``wanted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), TEXTS_AT_ONCE):
                sets = [shingles(t, shingle) for t in batch["text"].iloc[lo : lo + TEXTS_AT_ONCE]]
                yield pd.DataFrame({"_n": [node(s) for s in sets], "_set": [s.view(np.int64) for s in sets]})
        release()

    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_x"), whole_text().alias("text"))
    wanted = wanted.hint("merge")  # one plan at every size
    here = source.join(wanted, (source["_x"] == wanted["_h"]) & source["_id"].eqNullSafe(wanted["_i"]), "left_semi")
    return here.select("text").mapInPandas(run, "_n long, _set array<long>").dropDuplicates(["_n"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs _a, _b whose sets are similar enough; exact, in whole numbers."""
    up, down = LEAST
    a, b = (sets.select(F.col("_n").alias(n), F.col("_set").alias(f"_s{n}")) for n in ("_a", "_b"))
    both = pairs.join(a, "_a").join(b, "_b")
    shared = F.size(F.array_intersect("_s_a", "_s_b"))
    return both.where(shared * (up + down) >= up * (F.size("_s_a") + F.size("_s_b"))).select("_a", "_b")


def open_rows(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that hold several components."""
    rows = materialise(members.join(label, "_n"), "shingle-rows")
    several = rows.groupBy("_bucket").agg((F.min("_root") != F.max("_root")).alias("_several"), F.count(F.lit(1)).alias("_count")).where("_several")
    out = materialise(rows.join(several.select("_bucket", "_count"), "_bucket"), "shingle-open")
    discard(rows)
    return out


def with_links(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links (_a, _b) between them."""
    links = materialise(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "shingle-links")
    if links.isEmpty():
        return label
    root = components(links)
    new = label.join(root.select(F.col("_fp").alias("_root"), F.col("_root").alias("_new")), "_root", "left")
    out = materialise(new.select("_n", F.coalesce("_new", "_root").alias("_root")), "shingle-labels")
    discard(links, root, label)
    return out


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places in ``left``, in ``right``, which are places in ``sets``) that are similar enough, by products of
    matrices over a part of the shingles at a time."""
    size = np.array([len(x) for x in sets], dtype=np.float64)
    member = np.repeat(np.arange(len(sets)), size.astype(int))
    _, token, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = n[token] > 1  # a shingle of one member is shared with none
    member, token = member[many], np.unique(token[many], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    member, token = member[order], token[order]
    shared = np.zeros((len(left), len(right)))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        at = slice(*np.searchsorted(token, [lo, lo + COLUMNS]))
        holds = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        holds[member[at], token[at] - lo] = 1
        shared += holds[left] @ holds[right].T
    up, down = LEAST
    return np.nonzero(shared * (up + down) >= up * (size[left][:, None] + size[right][None, :]))


def block_links(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of components (_a, _b) that two blocks of members link: all sets of one are compared with all of the
    other (of one block: with each other)."""
    own = group["_own"].to_numpy()
    if own[0] == own[-1] and (own == own[0]).all():
        left = right = np.arange(len(group))
    else:
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    i, j = alike([np.asarray(x) for x in group["_set"]], left, right)
    root = group["_root"].to_numpy()
    a, b = root[left[i]], root[right[j]]
    return pd.DataFrame({"_a": np.minimum(a, b), "_b": np.maximum(a, b)})[a != b].drop_duplicates()


def linked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """_n and _root of the ``members`` (_bucket, _n, _size).

    First every bucket proposes its members against ``CENTRES`` of them, those that stand in most buckets; that is
    linear in the bucket and joins its large groups. Buckets that still hold several components are then searched
    whole, in blocks of ``BLOCK`` members: every two blocks meet in a task, which gives back the components that it
    links, never pairs of members."""
    up, down = LEAST
    degree = members.groupBy("_n").agg(F.count(F.lit(1)).alias("_degree"))
    label = materialise(degree.select("_n", F.col("_n").alias("_root")), "shingle-labels")
    rows = members.join(degree, "_n")
    best = F.min(F.struct((-F.col("_degree")).alias("d"), F.xxhash64("_n").alias("h"), F.col("_n").alias("n"), F.col("_size").alias("s")))
    centre = rows.groupBy("_bucket", F.pmod(F.xxhash64("_n", "_bucket"), F.lit(CENTRES))).agg(best.alias("_c"))
    centre = centre.select("_bucket", F.col("_c.n").alias("_m"), F.col("_c.s").alias("_other"))
    near = F.least("_size", "_other") * down >= F.greatest("_size", "_other") * up  # others cannot be similar enough
    pairs = rows.join(centre, "_bucket").where((F.col("_n") != F.col("_m")) & near)
    pairs = materialise(pairs.select(F.least("_n", "_m").alias("_a"), F.greatest("_n", "_m").alias("_b")).distinct(), "shingle-pairs")
    label = with_links(label, similar(pairs, sets))
    rest = open_rows(members.select("_bucket", "_n"), label)
    if not rest.isEmpty():
        blocks = F.ceil(F.col("_count") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("_n", "_bucket"), blocks).cast("int")
        dealt = rest.select("_bucket", "_n", "_root", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_with"))
        dealt = dealt.select("_n", "_root", "_own", F.xxhash64("_bucket", F.least("_own", "_with"), F.greatest("_own", "_with")).alias("_task"))
        found = dealt.join(sets, "_n").groupBy("_task").applyInPandas(block_links, "_a long, _b long")
        label = with_links(label, found)
    discard(pairs, rest)
    return label


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """_bucket and _n: the sets of shingles of each group of texts that their fingerprints (_fp) link."""
    links = simhash.links(rows.select("_fp").distinct())
    group = components(links)
    own = rows.select("_n", "_fp").distinct().join(group.withColumnRenamed("_root", "_group"), "_fp", "left")
    out = materialise(own.select(F.xxhash64(F.lit(BANDS), F.coalesce("_group", "_fp")).alias("_bucket"), "_n").distinct(), "shingle-prints")
    discard(links, group)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest ``doc_id``, of rows that share it the one of least text
    hash, of equal rows one."""
    rows = materialise(signed(docs), "shingle-rows")
    rank = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_h").alias("h"))
    nodes = materialise(rows.groupBy("_n").agg(F.min(rank).alias("_least"), F.min("_size").alias("_size"), F.first("_bands").alias("_bands")), "shingle-nodes")
    filed = nodes.select("_n", "_size", F.posexplode("_bands").alias("_b", "_k")).select(F.xxhash64("_b", "_k").alias("_bucket"), "_n", "_size")
    prints = by_fingerprint(rows)
    filed = filed.unionByName(prints.join(nodes.select("_n", "_size"), "_n"))
    # Buckets with equal members (two sums of hashes stand for them) say the same, so one of them is enough.
    buckets = filed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("_n")).alias("_x"), F.bit_xor(F.xxhash64("_n", F.lit(1))).alias("_y")
    )
    buckets = materialise(buckets.where("_c > 1").groupBy("_c", "_x", "_y").agg(F.min("_bucket").alias("_bucket")).select("_bucket"), "shingle-buckets")
    members = materialise(filed.join(buckets, "_bucket", "left_semi"), "shingle-members")
    wanted = nodes.join(members, "_n", "left_semi").select(F.col("_least.i").alias("_i"), F.col("_least.h").alias("_h"))
    wanted = materialise(wanted, "shingle-wanted")
    sets = materialise(shingle_sets(docs, wanted), "shingle-sets")
    label = linked(members, sets)
    owned = nodes.select("_n", "_least").join(label, "_n", "left").withColumn("_root", F.coalesce("_root", "_n"))
    least = owned.groupBy("_root").agg(F.min("_least").alias("_least")).select(F.col("_least.i").alias("_id"), F.col("_least.h").alias("_h"))
    out = keep_least(docs, least, rows)
    discard(rows, nodes, buckets, members, wanted, sets, label, prints)
    return out
