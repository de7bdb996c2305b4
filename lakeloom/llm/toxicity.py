"""Toxicity by compression distance to zstandard dictionaries.

Two dictionaries are trained on a bounded sample of labelled documents: one holds the words that occur in a share
of the ordinary texts, the other those of the toxic texts too (the ordinary language they share comes first, the
words that only toxic texts repeat last). The library's own trainer keeps the commonest substrings, which in both
classes are those of the common language; its dictionaries separate far worse (figures in the README).

A text is cut into windows of ``WINDOW_WORDS`` words, and each window is compressed under both; the difference in
bytes is its distance to ordinary text. How much likelier a difference is in toxic than in ordinary texts is read off
documents that the dictionaries have not seen: the sample is dealt into ``PARTS`` parts, and each is measured with
dictionaries of the others. From each window's evidence a drift is taken off, the geometric mean of what a window of
ordinary and one of toxic texts has, so that ordinary text counts against and length alone does not add up. A document
is toxic if the sum of all its windows or that of its best stretch of windows (so a toxic passage does not drown in a
long text) passes its threshold: the first is set where ``WRONGLY`` of the ordinary documents pass, the second above
the best stretch of the ordinary texts in a row, which stand for a long one, and rising with the logarithm of the
length. The score is a logistic curve through 0.7 there.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1, at most ``SAMPLE`` a class (the least hashes of
the id), of any length, while they fit ``SAMPLE_BYTES`` together; all documents are scored whole, map-only.

Defined results: null and empty texts have no window and score low; without labels of both classes all score 0;
of several labels of one document the highest counts; repeated rows are scored each; a null ``doc_id`` is kept
(and never labelled or held out); an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, only, release, table, whole_text

WINDOW_WORDS = 3
SAMPLE = {1: 2500, 0: 7500}
#: Bytes of the whole sample, which the driver holds; a row that does not fit is passed over.
SAMPLE_BYTES = 100_000_000
#: Share of a class's documents in which a word must occur to enter its dictionary.
SHARE = {1: 0.012, 0: 0.0005}
THRESHOLD = 0.7
#: Parts of the sample that are measured unseen, and the share of ordinary documents that may pass by their sum.
PARTS, WRONGLY = 4, 0.01
#: Chance that an ordinary document passes by its best stretch.
CHANCE = 0.001
FOLDS, HELD_OUT = 3, 1
LOW, HIGH = -10, 30  # differences beyond count as these
MIN_MATCH, KNOWN_WORDS = 5, 400_000

WORD = re.compile(r"\w+")
#: The compressor starts no match in a window's last bytes, so each window ends with these.
TAIL = b" \0\1\2\3\4\5\6\7"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weight: tuple[float, ...]  # evidence of each difference from LOW to HIGH
    drift: float  # taken off each window
    threshold: float  # of the sum over all windows
    stretch: float  # of the best stretch
    slope: float

    def evidence(self, differences: np.ndarray) -> float:
        """How far a document is above the nearer threshold."""
        whole, best = sums(np.array(self.weight)[differences], self.drift)
        # Evidence being log ratios, the best stretch of n ordinary windows passes h with a chance of n exp(-h) at most.
        return max(whole - self.threshold, best - max(self.stretch, np.log(max(1, len(differences)) / CHANCE)))


def sums(evidence: np.ndarray, drift: float) -> tuple[float, float]:
    """Less the drift: the sum over all windows, and that over the best stretch of windows (0 at least)."""
    total = np.r_[0.0, np.cumsum(evidence - drift)]
    return float(total[-1]), float((total - np.minimum.accumulate(total)).max())


class Distance:
    """Compressed lengths under both dictionaries.

    The toxic dictionary goes on where the ordinary one ends. Only a window that shares ``MIN_MATCH`` bytes with what it
    has more can be shortened by it; all others have the difference 0 and are not compressed. Words are judged once
    (``KNOWN_WORDS`` are remembered)."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic)
        more = toxic[max(0, len(ordinary) - 1) :]
        self.grams = {more[i : i + MIN_MATCH] for i in range(len(more) - MIN_MATCH + 1)}
        self.known: dict[str, bool] = {}

    @staticmethod
    def _compressor(content: bytes):
        size = 18
        p = zstandard.ZstdCompressionParameters(
            window_log=22, hash_log=size, chain_log=size, search_log=9, min_match=MIN_MATCH, target_length=64,
            strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def _touches(self, word: str) -> bool:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        raw = f" {word} ".encode()
        out = self.known[word] = any(raw[i : i + MIN_MATCH] in self.grams for i in range(len(raw) - MIN_MATCH + 1))
        return out

    def of(self, text: str) -> np.ndarray:
        """The differences of a text's windows, as places from LOW to HIGH."""
        words = WORD.findall(text.lower())
        out = np.full(-(-len(words) // WINDOW_WORDS), -LOW)
        touched = list(map(self.known.get, words))
        if None in touched:
            touched = [self._touches(w) if t is None else t for w, t in zip(words, touched, strict=True)]
        for k in sorted({i // WINDOW_WORDS for i, t in enumerate(touched) if t}):
            w = b" " + " ".join(words[k * WINDOW_WORDS : (k + 1) * WINDOW_WORDS]).encode() + TAIL
            out[k] = min(max(len(self.ordinary(w)) - len(self.toxic(w)), LOW), HIGH) - LOW
        return out


def dictionary(words: list[str]) -> bytes:
    return b" " + b" \0 ".join(w.encode() for w in words) + b" "


def frequent(texts: list[str], share: float) -> list[str]:
    """Words in at least this share of the texts, the most frequent last."""
    found: Counter = Counter()
    for t in texts:
        found.update(set(WORD.findall(t.lower())))
    least = max(2, share * len(texts))
    return [w for w, n in sorted(found.items(), key=lambda x: (x[1], x[0])) if n >= least]


def trained(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    shared = frequent(ordinary, SHARE[0])
    known = set(shared)
    return dictionary(shared), dictionary(shared + [w for w in frequent(toxic, SHARE[1]) if w not in known])


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Dictionaries from all texts; evidence and thresholds from parts that other dictionaries measured unseen."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return None
    seen: list[list[np.ndarray]] = [[], []]
    for k in range(PARTS):
        distance = Distance(*trained(*([t for i, t in enumerate(texts) if i % PARTS != k] for texts in (toxic, ordinary))))
        for texts, found in zip((toxic, ordinary), seen, strict=True):
            found += [distance.of(t) for t in texts[k::PARTS]]
    width = HIGH - LOW + 1
    counts = [sum((np.bincount(d, minlength=width) for d in part), np.zeros(width)) for part in seen]
    ratio = np.log((counts[0] + 0.5) / (counts[0].sum() + 1)) - np.log((counts[1] + 0.5) / (counts[1].sum() + 1))
    weight = np.where(np.arange(width) >= 2 - LOW, np.maximum(ratio, 0), 0)
    weight = np.minimum.accumulate(np.maximum.accumulate(weight)[::-1])[::-1]  # a larger difference is no weaker evidence
    of_toxic, of_ordinary = (((weight * c).sum() + 0.5) / (c.sum() + 1) for c in counts)
    drift = float(np.sqrt(of_toxic * of_ordinary))
    whole = np.sort([sums(weight[d], drift)[0] for d in seen[1]])
    threshold = max(float(whole[-1 - int(WRONGLY * len(whole))]), 0.0) + 1e-6
    # Ordinary texts in a row (but the worst in a hundred, whose labels may be wrong) stand for a long one: by one
    # window of the strongest evidence its best stretch must not pass.
    rest = sorted(seen[1], key=lambda d: sums(weight[d], drift)[1])[: -(-len(seen[1]) * 99 // 100)]
    stretch = sums(weight[np.concatenate(rest)], drift)[1] + max(float(weight.max()), 1.0)
    return Model(*trained(toxic, ordinary), tuple(map(float, weight)), drift, threshold, stretch, 1.0)


def labelled(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """The bounded training sample: (label, text)."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    least = None
    for label, n in SAMPLE.items():
        part = marks.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        least = part if least is None else least.unionAll(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    sized = rows.join(F.broadcast(least), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("_text")).alias("n")).toPandas()  # SAMPLE bounds it
    sized = sized.sort_values("doc_id", key=lambda c: (c * 2654435761) % (1 << 32))
    fit_in, held = [], 0
    for doc, n in zip(sized["doc_id"].tolist(), sized["n"].tolist(), strict=True):
        if held + n <= SAMPLE_BYTES:
            fit_in.append((doc,))
            held += n
    chosen = docs.sparkSession.createDataFrame(fit_in, "doc_id long")
    rows = rows.join(F.broadcast(least.join(chosen, "doc_id")), "doc_id")
    found = rows.groupBy("doc_id", "_toxic").agg(F.min("_text").alias("_text")).toPandas().sort_values("doc_id", key=lambda c: (c * 2654435761) % (1 << 32))
    return list(zip(found["_toxic"], found["_text"], strict=True))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = labelled(docs, labels)
    return fit([t for k, t in sample if k == 1], [t for k, t in sample if k == 0])


ROWS_AT_ONCE = 512


def scorer(model: Model | None) -> Callable[[list[str]], np.ndarray]:
    """Scores of texts in this process; the dictionaries are prepared once."""
    if model is None:
        return lambda texts: np.zeros(len(texts))
    key = (model.ordinary, model.toxic)
    distance = only(key, lambda: Distance(*key))

    def of(texts: list[str]) -> np.ndarray:
        evidence = np.array([model.evidence(distance.of(t)) for t in texts])
        x = np.clip(evidence * model.slope + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)
        return 1 / (1 + np.exp(-x))

    return of


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(model)
        for batch in batches:
            scores = of(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "predicted": (scores >= THRESHOLD).astype("int32")})

    source = docs.select(id_text().alias("doc_id"), whole_text().alias("text"))
    found = source.mapInPandas(run, "doc_id string, score double, predicted int").withColumn("doc_id", F.col("doc_id").cast("long"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns. Rows pass as Arrow batches, whatever their columns."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(of(texts) < THRESHOLD))
        release()

    return docs.mapInArrow(run, docs.schema)


def op6_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
