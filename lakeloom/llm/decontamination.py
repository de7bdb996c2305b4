"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case words (letters and digits). A mask names the positions of a window that count and ignores
the others; the two masks of ``MASKS`` are such that in any 13 aligned words with at most two substitutions one of
them falls on unchanged words only. Mask hashes of benchmark items meet those of the documents in a hash join, and
around each hit the words are compared position by position: an overlap is a window of ``WINDOW`` aligned words of
which ``AGREE`` or more are equal. An item of ``SHORTEST`` to 12 words overlaps where all its words stand in a row;
its mask is the whole item.

A benchmark of up to ``HASHES`` hashes is broadcast; a larger one is joined by shuffling the hashes. Either way every
document is read for all hashes at once, and once more for its words if it has a hit. Hits are gathered per document and
item, and each pair is compared once at every shift that a hit stands for, in the row that holds the document's words; at
all shifts if the two repeat words so often that hits outnumber them. Up to ``FOUND`` such pairs are broadcast, so texts
are shuffled only beyond that.

Only DataFrame expressions are used. Defined results: null or empty texts, and texts or items of fewer words than
that, overlap nothing; repeated rows give one result row; a null ``doc_id`` or ``item_id`` is kept as such; an empty
table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import materialise, table, whole_text

WINDOW = 13
AGREE = 11
MASKS = ((0, 1, 2, 3, 5, 8), (0, 3, 4, 6, 7, 8))
SHORTEST = 5
#: Bounds of what is broadcast: places of hashes (24 bytes each), rows found (16 bytes each), and the words and shifts
#: beside them (8 bytes each).
HASHES, FOUND, NUMBERS = 500_000, 500_000, 4_000_000


def words(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def spans(size: Column, short: list[int]) -> list[tuple[int, tuple[int, ...], Column]]:
    """(number, mask, how many places) of every mask that a text of ``size`` words is hashed with; ``short`` are the
    lengths of short items."""
    long = [(k, mask, F.when(size >= WINDOW, size - max(mask)).otherwise(F.lit(0))) for k, mask in enumerate(MASKS)]
    return long + [(100 + n, tuple(range(n)), F.greatest(size - (n - 1), F.lit(0))) for n in short]


def seeds(h: Column, short: list[int], item: bool = False) -> Column:
    """The mask hashes of a word array, those of one mask before those of the next, position by position. An item has
    those of its length only."""

    def of(k: int, mask: tuple[int, ...], n: Column) -> Column:
        if item and k >= 100:
            n = F.when(F.size(h) == len(mask), n).otherwise(F.lit(0))
        every = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + m) for m in mask]))
        return F.when(n > 0, every).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[of(*x) for x in spans(F.size(h), short)])


def place(at: Column, size: Column, short: list[int]) -> Column:
    """The word position of the seed at an index of ``seeds`` (of a document of ``size`` words)."""
    out, before = None, F.lit(0)
    for _, _, n in spans(size, short):
        out = F.when(at < before + n, at - before) if out is None else out.when(at < before + n, at - before)
        before = before + n
    return out.cast("int")


def hit_shifts(hits: DataFrame) -> DataFrame:
    """doc_id, text_hash, _key, _shifts: at which shifts (the document's word less the item's) to compare. Comes from
    hits (doc_id, text_hash, _n words, _key, _m words, _seed, _p, and _q, all places of the seed in the item). A seed that
    two texts repeat would give every pair of its places; if those are more than there are shifts, all shifts are taken,
    which finds the same overlaps."""
    seeds = hits.groupBy("doc_id", "text_hash", "_n", "_key", "_m", "_seed").agg(F.collect_set("_p").alias("_ps"), F.first("_q").alias("_q"))
    often = F.size("_ps").cast("long") * F.size("_q") > F.col("_n") + F.col("_m")
    pairs = F.flatten(F.transform("_ps", lambda p: F.transform("_q", lambda q: p - q)))
    seeds = seeds.select("doc_id", "text_hash", "_n", "_key", "_m", often.alias("_often"), F.when(~often, pairs).alias("_pairs"))
    found = seeds.groupBy("doc_id", "text_hash", "_n", "_key", "_m").agg(F.max("_often").alias("_often"), F.array_distinct(F.flatten(F.collect_list("_pairs"))).alias("_some"))
    every = F.sequence(1 - F.col("_m"), F.col("_n") - 1)
    return found.select("doc_id", "text_hash", "_key", F.when(F.col("_often") | (F.size("_some") > F.col("_n") + F.col("_m")), every).otherwise(F.col("_some")).alias("_shifts"))


def compared(hit: DataFrame) -> DataFrame:
    """Overlaps of hits (doc_id, text_hash, _item, _h, _w, _shifts). One row compares one document with one item, so a
    document's words stand once beside all their shifts."""
    hit = hit.withColumn("_win", F.least(F.size("_w"), F.lit(WINDOW)))
    hit = hit.withColumn("_need", F.when(F.col("_win") == WINDOW, AGREE).otherwise(F.col("_win"))).withColumn("_span", F.pow(F.lit(2), F.col("_win")).cast("int"))

    def equal(shift: Column) -> Column:
        lo = F.greatest(F.lit(0), -shift)
        n = F.greatest(F.lit(0), F.least(F.size("_w"), F.size("_h") - shift) - lo)
        return F.zip_with(F.slice("_h", lo + shift + 1, n), F.slice("_w", lo + 1, n), lambda a, b: (a == b).cast("int"))

    def step(s: Column, bit: Column) -> Column:
        """One word on: the last words' agreement as bits, how many words, the first good window's end, good windows."""
        bits, at = (s["bits"] * 2 + bit) % F.col("_span"), s["at"] + 1
        good = (at >= F.col("_win")) & (F.bit_count((s["bits"] * 2 + bit) % F.col("_span")) >= F.col("_need"))
        return F.struct(bits.cast("int").alias("bits"), at.alias("at"), F.when(good & (s["n"] == 0), at).otherwise(s["first"]).alias("first"), (s["n"] + good.cast("int")).alias("n"))

    def windows(shift: Column) -> Column:
        start = F.struct(*[F.lit(0).alias(c) for c in ("bits", "at", "first", "n")])
        return F.aggregate(equal(shift), start, step, lambda s: F.struct((F.greatest(shift, F.lit(0)) + s["first"] - F.col("_win")).alias("first"), s["n"].alias("n")))

    rows = hit.select("doc_id", "text_hash", "_item", F.transform("_shifts", windows).alias("_found"))
    rows = rows.select("doc_id", "text_hash", "_item", F.filter("_found", lambda x: x["n"] > 0).alias("_found"))
    found = rows.groupBy("doc_id", "text_hash", F.col("_item").alias("item_id")).agg(
        F.min(F.array_min(F.transform("_found", lambda x: x["first"]))).cast("long").alias("first_word"),
        F.max(F.array_max(F.transform("_found", lambda x: x["n"]))).cast("long").alias("n_windows"),
    )
    return found.where(F.col("n_windows") > 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, most_hashes: int = HASHES, most_found: int = FOUND) -> DataFrame:
    """Verified overlaps: doc_id, text_hash (of the row's text), item_id, first_word (in the document), n_windows."""
    items = benchmark.select(F.col("item_id").alias("_item"), whole_text().alias("_t")).distinct()
    items = items.select("_item", F.xxhash64("_item", "_t").alias("_key"), words(F.col("_t")).alias("_w")).where(F.size("_w") >= SHORTEST)
    items = materialise(items, "benchmark-items")
    short = sorted(r["n"] for r in items.select(F.size("_w").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # 8 numbers at most
    hashes = items.select("_key", "_w", F.posexplode(seeds(F.col("_w"), short, item=True)).alias("_at", "_seed"))
    own = F.when(F.size("_w") < WINDOW, F.lit(0)).otherwise(F.col("_at") % (F.size("_w") - max(MASKS[0])))
    hashes = hashes.groupBy("_key", F.size("_w").alias("_m"), "_seed").agg(F.collect_set(own.cast("int")).alias("_q"))  # of one item
    hashes = materialise(hashes, "benchmark-hashes")
    rows = docs.select("doc_id", whole_text().alias("_t"))
    rows = rows.select("doc_id", F.xxhash64("_t").alias("text_hash"), words(F.col("_t")).alias("_h"))
    # outer: otherwise the optimizer adds a filter that computes the words anew for every word
    # the number of words on its own, so that a seed's row does not carry all words along
    probes = rows.withColumn("_n", F.size("_h")).select("doc_id", "text_hash", "_n", F.posexplode_outer(seeds(F.col("_h"), short)).alias("_at", "_seed"))
    places = hashes.agg(F.sum(F.size("_q"))).first()[0] or 0
    # beyond the bound a shuffle; a seed that no item has goes before its row is dealt out
    hit = probes.join(F.broadcast(hashes), "_seed") if places <= most_hashes else probes.where(F.col("_seed").isNotNull()).join(hashes.hint("shuffle_merge"), "_seed")
    hit = hit.withColumn("_p", place(F.col("_at"), F.col("_n"), short))
    hit = materialise(hit_shifts(hit), "benchmark-hits").join(items, "_key")
    hit = hit.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_x"), "_item", "_w", "_shifts")
    size = hit.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_w") + F.size("_shifts")).alias("m")).first()
    found = F.broadcast(hit) if size["n"] <= most_found and (size["m"] or 0) <= NUMBERS else hit.hint("merge")
    here = rows.join(found, (rows["text_hash"] == hit["_x"]) & rows["doc_id"].eqNullSafe(hit["_d"]))
    return compared(here.select("doc_id", "text_hash", "_item", "_h", "_w", "_shifts"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns. Texts are shuffled only if more than
    ``FOUND`` documents go."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    found = materialise(found, "benchmark-found")
    same = docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(whole_text()) == found["_h"])
    return docs.join(F.broadcast(found) if found.count() <= FOUND else found, same, "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("n_windows").alias("n_windows"))
