"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of distinct two-word shingles (words as in ``simhash.WORDS``, A-Z lower-cased; fewer words are one
shingle). Its signature has ``CHUNKS`` x ``WIDTH`` positions, each ``BITS`` bits of a least hash, and two signatures
differ at a position with a chance of about 1 - similarity. By pigeonhole two signatures that differ at most at
2 x CHUNKS - 1 positions have a chunk with at most one error. So each chunk is filed once for every place that the
error may take, under the hash of its other positions, and two such signatures always meet in a bucket. A pair of a
similarity of just 0.8 meets in none with a chance of 0.263^10, 2 in a million; one of 0.85 with 2 in 10^8. Most buckets hold
one set only and are dropped after a count.

Links are confirmed on whole sets, in whole numbers; a pair whose signatures differ at over ``FAR`` positions (10^-7 at
0.8) is not looked at. Sets lie beside the pairs only there: they are made anew from the texts of the rows in a bit map
of fixed size, so texts are never shuffled.

No bucket is compared pair by pair. First each proposes its members against the one that stands in most buckets, which
joins large groups. What still lies in several components is gathered by the main component of its buckets, each member
once beside everything that it met; members outside the main component are compared with the others, in clusters of at
most ``SMALL`` as pairs, otherwise in blocks, as products of matrices. A cluster with more than ``MANY`` of them is filed
again under the rarest shingles of each member, so many that two sets of 0.8 share one (the prefix of a set in order of
frequency), which is exact, and each of these files is searched in blocks.

Defined results: a text without words has n_shingles 0 and is linked with nothing; repeated rows are linked; rows with a null
``doc_id`` are compared, and their component is null only if no member has an id (kept is true there); an empty table
gives an empty result; further columns do not matter. Sets are told apart by 64-bit hashes of their shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import discard, id_text, materialise, release, table, whole_text
from lakeloom.llm.shingle_dedup import LEAST, TEXTS_AT_ONCE, alike, node, shingles, similar, with_links

SHINGLE = 2
CHUNKS, WIDTH, BITS = 10, 5, 16
FAR = 26
SMALL, BLOCK, MANY = 32, 256, 4096
SEED = 42
AT_ONCE = 1024
#: Bits of the map of wanted rows: 16 MB whatever the input. It lets through more than was asked for, never less.
MAP_BITS = 1 << 27

_RANDOM = np.random.default_rng(SEED)
FLIPS = _RANDOM.integers(0, 1 << 64, CHUNKS * WIDTH, dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, CHUNKS * WIDTH, dtype=np.uint64) | np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """``BITS`` bits of the least of each position's hashes; those below the leading ones, which are nearly always 0."""
    least = np.full(len(FLIPS), ~np.uint64(0))
    for lo in range(0, len(found), AT_ONCE):
        least = np.minimum(least, ((found[None, lo : lo + AT_ONCE] ^ FLIPS[:, None]) * FACTORS[:, None]).min(axis=1))
    return (least >> np.uint64(20) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_id, _h (hash of the text), _n (hash of its set), _size and _sig of every row. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:  # one set at a time
                own = shingles(t, shingle)
                found.append((node(own), len(own), signature(own)))
            n, size, sig = zip(*found, strict=True) if found else ((), (), ())
            yield pd.DataFrame({"_id": batch["_id"], "_h": batch["_h"].to_numpy(), "_n": n, "_size": size, "_sig": sig})
        release()

    source = docs.select(id_text().alias("_id"), F.xxhash64(whole_text()).alias("_h"), whole_text().alias("text"))
    return source.mapInPandas(run, "_id string, _h long, _n long, _size long, _sig array<int>").withColumn("_id", F.col("_id").cast("long"))


def chunk_keys() -> Column:
    """Every chunk of a signature under each place of its one allowed error."""
    keys = []
    for chunk in range(CHUNKS):
        for error in range(WIDTH):
            rest = [F.get("_sig", F.lit(chunk * WIDTH + p)) for p in range(WIDTH) if p != error]
            keys.append(F.xxhash64(F.lit(chunk * WIDTH + error), *rest))
    return F.array(*keys)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """_bucket, _n, _size of the buckets with several members; of buckets with the same members (their number and two sums
    of hashes stand for them) one."""
    filed = nodes.select("_n", "_size", F.explode(chunk_keys()).alias("_bucket"))
    buckets = filed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"), F.bit_xor("_n").alias("_x"), F.bit_xor(F.xxhash64("_n")).alias("_y"))
    buckets = materialise(buckets.where("_c > 1").groupBy("_c", "_x", "_y").agg(F.min("_bucket").alias("_bucket")).select("_bucket"), "minhash-buckets")
    out = materialise(filed.join(buckets.hint("merge"), "_bucket", "left_semi"), "minhash-members")
    discard(buckets)
    return out


def row_bit(id: str, h: str) -> Column:
    return F.pmod(F.xxhash64(id, h), F.lit(MAP_BITS))


def wanted_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """_n and _set of the rows with the id ``_i`` and the text hash ``_h`` in ``wanted``, and of a few others."""
    words = wanted.select(row_bit("_i", "_h").alias("_b")).groupBy(F.shiftright("_b", 5).cast("int").alias("_w"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(_b % 32 AS int)))").alias("_v")).toPandas()  # 2^22 rows at most
    bits = np.zeros(MAP_BITS // 32, dtype=np.uint32)
    bits[words["_w"].to_numpy(dtype=np.int64)] = words["_v"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            at = batch["_b"].to_numpy()
            texts = batch["text"].to_numpy()[(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)]
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                sets = [shingles(t, shingle) for t in texts[lo : lo + TEXTS_AT_ONCE]]
                yield pd.DataFrame({"_n": [node(s) for s in sets], "_set": [s.view(np.int64) for s in sets]})
        release()

    source = docs.select(F.col("doc_id").cast("long").alias("_i"), F.xxhash64(whole_text()).alias("_h"), whole_text().alias("text"))
    out = materialise(source.select(row_bit("_i", "_h").alias("_b"), "text").mapInPandas(run, "_n long, _set array<long>").dropDuplicates(["_n"]), "minhash-sets")
    shared.unpersist()
    return out


def alike_in_size(a: str, b: str) -> Column:
    up, down = LEAST
    return F.least(a, b) * down >= F.greatest(a, b) * up


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs _a, _b that are similar enough; those with too different signatures are not compared."""
    pairs = pairs.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    a, b = (nodes.select(F.col("_n").alias(n), F.col("_sig").alias(f"_s{n}")) for n in ("_a", "_b"))
    differ = F.aggregate(F.zip_with("_s_a", "_s_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = materialise(pairs.join(a, "_a").join(b, "_b").where(differ <= FAR).select("_a", "_b"), "minhash-pairs")
    out = materialise(similar(close, sets), "minhash-links")
    discard(close)
    return out


def to_centres(members: DataFrame) -> DataFrame:
    """Each bucket's members against the one of them that stands in most buckets."""
    rows = members.join(members.groupBy("_n").agg(F.count(F.lit(1)).alias("_degree")), "_n")
    best = F.min(F.struct((-F.col("_degree")).alias("d"), F.xxhash64("_n").alias("h"), F.col("_n").alias("n"), F.col("_size").alias("s")))
    centre = rows.groupBy("_bucket").agg(best.alias("_c")).select("_bucket", F.col("_c.n").alias("_m"), F.col("_c.s").alias("_other"))
    pairs = members.join(centre, "_bucket").where((F.col("_n") != F.col("_m")) & alike_in_size("_size", "_other"))
    return pairs.select(F.col("_n").alias("_a"), F.col("_m").alias("_b"))


def clustered(rows: DataFrame) -> DataFrame:
    """The members of each _bucket that holds several components, with _main, the component of most of them, _count of
    members, and _minority, how many are in others."""
    each = rows.groupBy("_bucket", "_root").agg(F.count(F.lit(1)).alias("_c"))
    main = each.groupBy("_bucket").agg(F.max(F.struct("_c", "_root")).alias("_m"), F.sum("_c").alias("_count"))
    main = main.select("_bucket", F.col("_m._root").alias("_main"), "_count", (F.col("_count") - F.col("_m._c")).alias("_minority"))
    return materialise(rows.join(main.where("_minority > 0"), "_bucket"), "minhash-clusters")


def clusters(members: DataFrame, label: DataFrame) -> DataFrame:
    """The undecided members gathered by the main component of their bucket: the many buckets that a group of near copies
    fills have the same one, so its members stand once beside everything that met them."""
    rows = clustered(members.join(label, "_n"))
    out = clustered(rows.select(F.col("_main").alias("_bucket"), "_n", "_root", "_size").distinct())
    discard(rows)
    return out


def within_small(rows: DataFrame) -> DataFrame:
    """The pairs of different components among at most ``SMALL`` members."""
    mine = rows.where(F.col("_count") <= SMALL)
    a, b = (mine.select("_bucket", F.col("_n").alias(n), F.col("_root").alias(f"_r{n}"), F.col("_size").alias(f"_z{n}")) for n in ("_a", "_b"))
    return a.join(b, "_bucket").where((F.col("_a") < F.col("_b")) & (F.col("_r_a") != F.col("_r_b")) & alike_in_size("_z_a", "_z_b")).select("_a", "_b")


def refiled(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of large buckets under (bucket, shingle) for the rarest shingles of each: two sets of which neither
    has less than 4/5 of the other in common share one of them."""
    up, down = LEAST
    each = large.select("_bucket", "_n", "_size").join(sets, "_n").select("_bucket", "_n", "_size", F.explode("_set").alias("_t"))
    often = each.groupBy("_bucket", "_t").agg(F.count(F.lit(1)).alias("_often"))
    each = each.join(often, ["_bucket", "_t"]).groupBy("_bucket", "_n", "_size").agg(F.sort_array(F.collect_list(F.struct("_often", "_t"))).alias("_all"))  # one set
    prefix = F.col("_size") - F.floor((up * F.col("_size") + down - 1) / down) + 1
    out = each.select("_bucket", "_n", "_size", F.explode(F.slice("_all", F.lit(1), prefix.cast("int"))).alias("_x")).where("_x._often > 1")
    return out.select(F.xxhash64("_bucket", "_x._t").alias("_bucket"), "_n", "_size")


def cluster_links(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of components (_a, _b) that a block of the minority and a block of all members link."""
    asks = group["_asks"].to_numpy()
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(left) or not len(right):
        return pd.DataFrame({"_a": np.array([], dtype=np.int64), "_b": np.array([], dtype=np.int64)})
    i, j = alike([np.asarray(x) for x in group["_set"]], left, right)
    root = group["_root"].to_numpy()
    a, b = root[left[i]], root[right[j]]
    return pd.DataFrame({"_a": np.minimum(a, b), "_b": np.maximum(a, b)})[a != b].drop_duplicates()


def by_blocks(large: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between components of large clusters: every block of the minority meets every block of all members in a
    task, which returns components, never pairs of members."""
    n, asking = F.ceil(F.col("_count") / BLOCK).cast("int"), F.ceil(F.col("_minority") / BLOCK).cast("int")
    own = lambda k: F.pmod(F.xxhash64("_n", "_bucket"), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    few = large.where(F.col("_root") != F.col("_main")).select("_bucket", "_n", "_root", F.lit(True).alias("_asks"), own(asking).alias("_i"), each(n).alias("_j"))
    every = large.select("_bucket", "_n", "_root", F.lit(False).alias("_asks"), own(n).alias("_j"), each(asking).alias("_i"))
    dealt = few.unionByName(every).select("_n", "_root", "_asks", F.xxhash64("_bucket", "_i", "_j").alias("_task"))
    return dealt.join(sets, "_n").groupBy("_task").applyInPandas(cluster_links, "_a long, _b long")


def components_of(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """_n and _root of the ``members`` (_bucket, _n, _size); see the module's text for the order of work."""
    label = materialise(members.select("_n").distinct().withColumn("_root", F.col("_n")), "minhash-labels")
    found = confirmed(to_centres(members), nodes, sets)
    label = with_links(label, found)
    rest = clusters(members, label)
    few = confirmed(within_small(rest), nodes, sets)
    some = materialise(by_blocks(rest.where((F.col("_count") > SMALL) & (F.col("_minority") <= MANY)), sets), "minhash-links")
    label = with_links(label, few.unionAll(some))
    many = rest.where((F.col("_count") > SMALL) & (F.col("_minority") > MANY))
    if not many.isEmpty():
        part = clustered(refiled(many, sets).join(label, "_n"))
        label = with_links(label, by_blocks(part, sets))
        discard(part)
    discard(found, rest, few, some)
    return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = materialise(signed(docs, shingle), "minhash-rows")
    rank = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_h").alias("h"))
    nodes = rows.where("_size > 0").groupBy("_n").agg(F.min(rank).alias("_least"), F.min("_size").alias("_size"), F.first("_sig").alias("_sig"))
    nodes = materialise(nodes, "minhash-nodes")
    members = bucket_members(nodes)
    wanted = nodes.join(members.select("_n").distinct().hint("merge"), "_n", "left_semi").select(F.col("_least.i").alias("_i"), F.col("_least.h").alias("_h"))
    sets = wanted_sets(docs, wanted, shingle)
    label = components_of(members, nodes, sets)
    owned = nodes.select("_n", "_least").join(label, "_n", "left").withColumn("_root", F.coalesce("_root", "_n"))
    least = owned.groupBy("_root").agg(F.min("_least").alias("_first"))
    named = owned.join(least, "_root").select("_n", F.col("_first.i").alias("_component"))
    out = rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("n_shingles"), "_n").join(named, "_n", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
