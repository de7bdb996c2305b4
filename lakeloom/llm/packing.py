"""Best-fit packing of token sequences by bulk-synchronous successor sweeps.

Tokens: a text's words are encoded once per process and remembered (``CACHE_CHUNKS`` at most); white space never
belongs to a token of this vocabulary, so words are independent. An end id follows each document. Documents
longer than the capacity are cut into full pieces and a shorter last one.

Packing: documents of one length are interchangeable, and so are gaps of one size, so the range-sorted documents
and gaps are swept as runs (length, how many) and (gap, how many, first sequence); there are at most ``capacity``
lengths, whatever the corpus. A round takes the runs from long to short, gives each document the successor
(smallest gap that holds it), resolves conflicts by rank (document r of the run takes place r of the gap run),
shrinks the gaps and goes on until the run is placed; what finds no gap opens sequences. That is best-fit
decreasing, carried out in bulk. The plan, a few rows per length, is joined back by length and rank. Ranks come
from counts per (length, part as written), so no length, however frequent, is gathered in one task.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each; a null
``doc_id`` is kept; further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, materialise, only, release, table, whole_text
from lakeloom.llm.token_counts import byte_alphabet

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 600_000

#: Fixed value: the white space of this vocabulary's pattern. ``str.split`` also splits at the four separators.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Fixed value: this vocabulary's pieces of a word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
FAR = re.compile("[\x1c-\x1f\u0130\u0180-\U0010ffff]")
SEPARATORS = re.compile(r"[\x1c-\x1f]")


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    Words that hold only characters up to U+017F (but U+0130) are their own normal form, so their pieces go
    straight to the model; all others take the library's whole path."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cache_chunks = cache_chunks

    def piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.cache_chunks:
            self.pieces.clear()
        stands = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
        ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(stands)], dtype="<u4").tobytes()
        return ids

    def word(self, word: str) -> bytes:
        if len(self.known) >= self.cache_chunks:
            self.known.clear()
        if FAR.search(word) or any(s in word for s in self.special):
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            ids = b"".join(self.pieces.get(p) or self.piece(p) for p in PIECES.findall(word.lower()))
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = [w for w in SPACE.split(text) if w] if SEPARATORS.search(text) else text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            ids = [self.word(w) if i is None else i for w, i in zip(words, ids, strict=True)]
        return b"".join(ids)


def encoder(path: str | None = None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return only(("word encoder", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, step = encoder(path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    source = docs.select(id_text().alias("doc_id"), whole_text().alias("text"))
    out = source.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan rows (length, rank_from, rank_to, sequence_from, per_sequence, offset) for runs {length: how many}.

    Ranks rank_from..rank_to - 1 of a length go to sequences sequence_from, ... in order, ``per_sequence`` each,
    the first of each at ``offset``."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size: runs (first sequence, how many)
    sizes: list[int] = []  # the gap sizes in use, sorted
    next_sequence = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first = capacity, next_sequence
                n = -(-left // (capacity // length))
                next_sequence += n
            fit = gap // length
            full = min(n, left // fit)
            if full:
                plan.append((length, rank, rank + full * fit, first, fit, capacity - gap))
                put(gap - fit * length, first, full)
                rank += full * fit
                left -= full * fit
                first, n = first + full, n - full
            if left and n:
                plan.append((length, rank, rank + left, first, left, capacity - gap))
                put(gap - left * length, first, 1)
                rank += left
                left = 0
                first, n = first + 1, n - 1
            put(gap, first, n)
    return plan


PLAN = "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, offset_from long"


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    Ranks count within a stored number, ``_part``, which is written with the rows: the partitions of a scan of them
    may differ from one reading to the next."""
    spark = rows.sparkSession
    rows = materialise(rows.withColumn("_part", F.spark_partition_id()), "packing-pieces")
    counts = materialise(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    if any(not 0 < length <= capacity for length in totals):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = F.broadcast(spark.createDataFrame(sweep(totals, capacity), PLAN))  # a few rows per length, so bounded by the capacity
    before = counts.withColumn("_before", F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_own", F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    here = (ranked["length"] == plan["length"]) & (ranked["_rank"] >= plan["rank_from"]) & (ranked["_rank"] < plan["rank_to"])
    nth = F.col("_rank") - F.col("rank_from")
    return ranked.join(plan, here).select(
        *[ranked[c] for c in rows.columns if c != "_part"],
        (F.col("sequence_from") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + nth % F.col("per_sequence") * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
