"""Exact removal of repeated 50-byte strings with a logarithmic family of sampled suffix arrays.

Which suffixes are kept. Of the 50-byte strings (windows) of a text, neighbours that share their smallest
``ANCHOR``-byte hash form a run; one suffix a run enters the index, sorted by two keys: K, the hash of the shared
anchor, and C, a BLAKE2 digest of all bytes of the run. Equal windows have equal anchors, wherever they stand, so
every match of 50 bytes or more lies within one K. About one suffix in 14 is kept; the choice loses no match.

The family. The index is dealt by K. Batches of suffixes get a sorted array each. A new array is merge-scanned
against every existing level: of entries with equal (K, C), those of the larger document are long matches and leave
the index, whichever side they stand on. Then the array joins the family, in which neighbouring levels of like size
merge into one, so each suffix is merged a logarithmic number of times and the levels hold each string once, for
its smallest document. Runs that share K but not C may still share some windows; for those alone the second level
indexes every window. Matches inside a block are resolved (byte by byte) before anything is sent, so a passage that
a third of all documents hold is sent once a block.

Hot anchors. A short string in many contexts has one K with many runs. A block that holds ``HOT`` or more runs of
one K sends a mark for it and hands the runs to the second level; the task that owns K then does the same with the
runs other blocks sent. There the whole windows are the keys, so nothing but equal windows meets.

Across blocks 32 bits of K and 64 of C (besides the bucket's number, a further part of K) stand for the bytes.
Two different runs of one anchor pass for equal with a chance of 2^-64; for 10^14 such pairs that is 5e-6.

Defined results: a null text counts as empty; texts of under 50 bytes lose nothing; rows that share a ``doc_id``
don't match each other; a null ``doc_id`` ranks as the largest id, 2^63 - 1; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, materialise, only, partitions, release, table, whole_text

WINDOW = 50
ANCHOR = 24
BLOCK = 1 << 21
FAN = 2
BATCH = 1 << 15
HOT = 64
ROWS_AT_ONCE = 512
BYTES_PER_BUCKET = 16 << 20
UNKNOWN_SIZE = 1 << 60
LAST = (1 << 63) - 1  # the rank of a null doc_id


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes of all substrings of a block, from one cumulative sum."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.up, self.down = self._powers(base, size), self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.values[data] * self.down[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.up[start])

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mixed((sums[length:] - sums[:-length]) * self.up[:n])


def hasher(seed: int) -> Hasher:
    size = 2 * BLOCK + 2 * WINDOW
    return only(("suffix hasher", seed, size), lambda: Hasher(seed, size))


def smallest_of(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours, by doubling."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : len(x) - size + 1]) if size < n else out


def runs(data: np.ndarray, valid: np.ndarray, anchor: int) -> tuple[np.ndarray, ...]:
    """K, C, first window and number of windows of the runs of valid windows (``valid`` by window start)."""
    h = hasher(1)
    sums = h.sums(data)
    least = smallest_of(h.every(sums, anchor), WINDOW - anchor + 1)
    before = np.r_[False, valid[:-1]]
    changes = np.r_[True, least[1:] != least[:-1]]
    start = np.flatnonzero(valid & (~before | changes))
    end = np.flatnonzero(valid & np.r_[~valid[1:] | changes[1:], True]) + 1
    return least[start], h.between(sums, start, end + WINDOW - 1), start, end - start


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins in sorted arrays."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def covered(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and length of the bytes that windows cover; neighbours are joined."""
    first, end = at.astype(np.int64), at.astype(np.int64) + length + WINDOW - 1
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    new = groups(doc)
    new[1:] |= first[1:] > end[:-1]
    start = np.flatnonzero(new)
    return (doc[start], first[start], np.maximum.reduceat(end, start) - first[start]) if len(start) else (doc, first, end)


class Block:
    """Runs of some documents: anchor hash, hash of the bytes, document (a place in ``doc_id`` and ``mark``), place in
    the block, first window in the document, windows."""

    def __init__(self, data, k, c, doc, place, at, length, doc_id, mark):
        self.data, self.k, self.c, self.doc, self.place, self.at, self.length = data, k, c, doc, place, at, length
        self.doc_id, self.mark = doc_id, mark

    def take(self, which: np.ndarray) -> Block:
        return Block(self.data, *(a[which] for a in (self.k, self.c, self.doc, self.place, self.at, self.length)), self.doc_id, self.mark)

    def strings(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some runs."""
        end = self.place[which] + self.length[which] + WINDOW - 1
        return list(map(self.data.__getitem__, map(slice, self.place[which].tolist(), end.tolist())))

    def settled(self) -> tuple[Block, Block]:
        """Matches within the block, and the rest: of equal runs those of the smallest document."""
        own = self.doc_id[self.doc]
        both = mixed(self.k ^ (self.c * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((own, both))
        new = groups(both[order])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        later = np.flatnonzero(own[order] > own[first])
        same = np.fromiter((x == y for x, y in zip(self.strings(order[later]), self.strings(first[later]), strict=True)), bool, len(later))
        gone = np.zeros(len(own), dtype=bool)
        gone[order[later[same]]] = True
        return self.take(np.flatnonzero(gone)), self.take(np.flatnonzero(~gone))

    def hot(self) -> np.ndarray:
        """Which runs have an anchor that many runs of this block share."""
        _, at, n = np.unique(self.k, return_inverse=True, return_counts=True)
        return n[at] >= HOT

    def spans(self, whole: bool) -> bytes:
        """Packed doc_id, mark and span of the bytes covered, or of the windows (``whole`` false)."""
        doc, first, n = covered(self.doc, self.at, self.length) if whole else (self.doc, self.at.astype(np.int64), self.length)
        return zstandard.compress(np.stack([self.doc_id[doc], self.mark[doc], first << 32 | n]).astype("<i8").tobytes(), 1)

    def dealt(self, buckets: int, marks: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The runs and the marked anchors by bucket, packed."""
        c = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in self.strings(np.arange(len(self.k)))]), dtype="<u8")
        bucket, marked = (((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) for k in (self.k, marks))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.union1d(np.flatnonzero(np.diff(ends)), marked).tolist():
            which = order[ends[b] : ends[b + 1]]
            docs, doc = np.unique(self.doc[which], return_inverse=True)
            known = marks[marked == b].astype("<u4")
            keys = known.tobytes() + self.k[which].astype("<u4").tobytes() + c[which].tobytes()
            rest = [np.diff(doc, prepend=0).astype("<i4"), self.at[which].astype("<i4"), self.length[which].astype("<i4")]
            rest = [a.view(np.uint8).reshape(-1, 4).T.tobytes() for a in rest]
            ids = np.diff(self.doc_id[docs], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
            plain = b"".join([ids, self.mark[docs].astype("<i8").tobytes(), *rest])
            yield b, np.array([len(known), len(which), len(docs)], dtype="<u4").tobytes() + keys + zstandard.compress(plain, 1)


class Suffixes:
    """Suffixes: key, doc_id, mark, first window, windows. A key is a complex number: numpy sorts and searches these
    by real part (32 bits of K, 11 of C), then imaginary part (53 bits of C), so that 96 bits compare as one."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        self.key, self.doc = columns[:2]

    def take(self, which: np.ndarray) -> Suffixes:
        return Suffixes(*(a[which] for a in self.columns))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*map(np.concatenate, zip(*(p.columns for p in parts), strict=True)))

    @staticmethod
    def unpacked(blob: bytes) -> tuple[Suffixes, np.ndarray]:
        """A packed block's suffixes, and the anchors it marks."""
        m, n, docs = np.frombuffer(blob, dtype="<u4", count=3).tolist()
        marks, k = (np.frombuffer(blob, dtype="<u4", count=x, offset=12 + y) for x, y in ((m, 0), (n, 4 * m)))
        c = np.frombuffer(blob, dtype="<u8", count=n, offset=12 + 4 * m + 4 * n)
        plain = zstandard.decompress(blob[12 + 4 * m + 12 * n :])
        doc_id = np.cumsum(np.frombuffer(plain, dtype=np.uint8, count=8 * docs).reshape(8, -1).T.copy().view("<i8").reshape(-1))
        mark = np.frombuffer(plain, dtype="<i8", count=docs, offset=8 * docs)
        rest = np.frombuffer(plain, dtype=np.uint8, offset=16 * docs).reshape(3, 4, -1)
        doc, at, length = (np.ascontiguousarray(a.T).view("<i4").reshape(-1) for a in rest)
        doc = np.cumsum(doc)
        key = np.empty(n, dtype=np.complex128)
        key.real = k.astype(np.float64) * 2048 + (c >> np.uint64(53)).astype(np.float64)
        key.imag = (c & np.uint64((1 << 53) - 1)).astype(np.float64)
        return Suffixes(key, doc_id[doc], mark[doc], at, length), marks

    def beaten(self, other: Suffixes) -> np.ndarray:
        """Which of these suffixes ``other`` holds for a smaller document; sorted arrays are scanned side by side."""
        if not len(self.key) or not len(other.key):
            return np.zeros(len(self.key), dtype=bool)
        at = np.minimum(np.searchsorted(other.key, self.key), len(other.key) - 1)
        return (other.key[at] == self.key) & (other.doc[at] < self.doc)


class IndexFamily:
    """Sorted suffix arrays in levels. Each string stands for its smallest document so far; ``matches`` has the rest."""

    def __init__(self):
        self.levels: list[Suffixes] = []  # from large to small
        self.matches: list[Suffixes] = []

    def _keep(self, rows: Suffixes, gone: np.ndarray) -> Suffixes:
        if not gone.any():
            return rows
        self.matches.append(rows.take(np.flatnonzero(gone)))
        return rows.take(np.flatnonzero(~gone))

    def add(self, rows: Suffixes) -> None:
        order = np.argsort(rows.doc, kind="stable")
        rows = rows.take(order[np.argsort(rows.key[order], kind="stable")])
        new = groups(rows.key)
        rows = self._keep(rows, rows.doc > rows.doc[np.flatnonzero(new)][np.cumsum(new) - 1])
        for i, level in enumerate(self.levels):
            rows = self._keep(rows, rows.beaten(level))
            self.levels[i] = self._keep(level, level.beaten(rows))
        self.levels.append(rows)
        while len(self.levels) > 1 and len(self.levels[-2].key) <= FAN * len(self.levels[-1].key):
            self._merge()

    def _merge(self) -> None:
        both = Suffixes.joined([self.levels.pop(-2), self.levels.pop()])
        self.levels.append(both.take(np.argsort(both.key, kind="stable")))

    def shared(self, marks: np.ndarray) -> Suffixes | None:
        """The kept suffixes whose anchor is marked or has several runs, not all of one document."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return None
        (rows,) = self.levels
        k = np.floor(rows.key.real / 2048)
        start = np.flatnonzero(groups(k))
        if not len(start):
            return None
        nth = np.cumsum(groups(k)) - 1
        several = np.maximum.reduceat(rows.doc, start) > np.minimum.reduceat(rows.doc, start)
        return rows.take(np.flatnonzero(several[nth] | np.isin(k, marks.astype(np.float64))))


SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])


def pieces(batches: Iterable[pa.RecordBatch], wanted: bool = False) -> Iterator[tuple]:
    """Blocks of whole texts (of parts, where a text is longer than a block): bytes, and per part its document's
    id and mark, first byte, end in the block and, if asked for, the wanted spans."""
    data, parts, size = [], [], 0
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(lo, ROWS_AT_ONCE)
            every = batch.column("spans").to_pylist() if wanted else [None] * batch.num_rows
            texts = batch.column("_all").field("text").to_pylist()
            for doc_id, mark, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), texts, every, strict=True):
                if wanted and spans is None or not text:
                    continue
                raw = text.encode()
                for first in range(0, len(raw) - WINDOW + 1, BLOCK):
                    part = raw[first : first + BLOCK + WINDOW - 1]
                    if size and size + len(part) > BLOCK:
                        yield b"".join(data), parts
                        data, parts, size = [], [], 0
                    data.append(part)
                    size += len(part)
                    parts.append((doc_id, mark, first, size, spans))
    if size:
        yield b"".join(data), parts


def block_runs(data: bytes, parts: list[tuple]) -> Block:
    """First level: the anchored runs of a block."""
    doc_id, mark = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)
    base, end = np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
    start = np.r_[0, end[:-1]]
    valid = np.repeat(end, end - start) - np.arange(len(data)) >= WINDOW
    k, c, at, length = runs(np.frombuffer(data, dtype=np.uint8), valid[: len(data) - WINDOW + 1], ANCHOR)
    doc = np.searchsorted(end, at, side="right")
    return Block(data, k, c, doc, at, at - start[doc] + base[doc], length, doc_id, mark)


def block_windows(data: bytes, parts: list[tuple]) -> Block:
    """Second level: every window of the wanted spans of a block."""
    doc_id, mark = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)
    where, doc, at, start = [], [], [], 0
    for i, (_, _, first, end, spans) in enumerate(parts):
        spans = np.unique(np.asarray(spans, dtype=np.int64))
        lo = np.maximum(spans >> 32, first)
        hi = np.minimum((spans >> 32) + (spans & 0xFFFFFFFF), first + end - start - WINDOW + 1)
        n = np.maximum(hi - lo, 0)
        w = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where.append(w - first + start)
        at.append(w)
        doc.append(np.full(len(w), i))
        start = end
    place = np.concatenate(where)
    h = hasher(1)
    k = h.between(h.sums(np.frombuffer(data, dtype=np.uint8)), place, place + WINDOW)
    return Block(data, k, k, np.concatenate(doc), place, np.concatenate(at), np.ones(len(place), dtype=np.int64), doc_id, mark)


def matched(docs: DataFrame, buckets: int, second: bool) -> DataFrame:
    """Spans doc_id, mark, span (first << 32 | length), sure: bytes to remove (sure), or runs of windows to look at.
    ``docs`` has doc_id, mark and a struct ``_all`` with the text (and spans, for the second level)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, parts in pieces(batches, second):
            here, rest = (block_windows if second else block_runs)(data, parts).settled()
            rows, marks = [], np.array([], dtype=np.uint64)
            if not second and (hot := rest.hot()).any():
                part = rest.take(np.flatnonzero(hot))
                rows.append((int(part.k[0] % np.uint64(buckets)), "look", part.spans(whole=False)))
                marks, rest = np.unique(part.k), rest.take(np.flatnonzero(~hot))
            rows += [(b, "suffixes", blob) for b, blob in rest.dealt(buckets, marks)]
            if len(here.k):
                rows.append((int(here.k[0] % np.uint64(buckets)), "sure", here.spans(whole=True)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["bucket", "kind", "blob"]), SENT, preserve_index=False)
        release()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        out, family, marks = [], IndexFamily(), [np.array([], dtype=np.uint32)]

        def found(rows: Suffixes, sure: bool) -> None:
            _, doc, mark, at, length = rows.columns
            span = at.astype(np.int64) << 32 | (length + (WINDOW - 1 if sure else 0))
            out.append(pd.DataFrame({"doc_id": doc, "mark": mark, "span": span, "sure": sure}))

        for kind, blob in zip(group["kind"], group["blob"], strict=True):
            if kind != "suffixes":
                doc, mark, span = np.frombuffer(zstandard.decompress(blob), dtype="<i8").reshape(3, -1)
                out.append(pd.DataFrame({"doc_id": doc, "mark": mark, "span": span, "sure": kind == "sure"}))
        waiting, n = [], 0
        for blob in group.loc[group["kind"] == "suffixes", "blob"]:
            rows, known = Suffixes.unpacked(blob)
            waiting.append(rows)
            marks.append(known)
            n += len(rows.key)
            if n >= BATCH:
                family.add(Suffixes.joined(waiting))
                waiting, n = [], 0
        if n:
            family.add(Suffixes.joined(waiting))
        for rows in family.matches:
            found(rows, True)
        if not second and (rest := family.shared(np.concatenate(marks))) is not None:
            found(rest, False)
        family = None
        release()
        return pd.concat(out).sort_values(["doc_id", "span"]) if out else pd.DataFrame({"doc_id": [], "mark": [], "span": [], "sure": []})

    sent = docs.mapInArrow(send, "bucket int, kind string, blob binary")
    return sent.groupBy("bucket").applyInPandas(meet, "doc_id long, mark long, span long, sure boolean")


def cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, maximal removed runs, and the kept stretches."""
    spans = np.sort(np.asarray(spans, dtype=np.int64))
    first, end = spans >> 32, np.maximum.accumulate((spans >> 32) + (spans & 0xFFFFFFFF))
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
    first, end = first[new], end[np.r_[new[1:] - 1, len(end) - 1]]
    kept = list(zip([0, *end.tolist()], [*first.tolist(), len(raw)], strict=True))
    return int((end - first).sum()), len(new), kept


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id (null as the largest), mark (the text's hash), ``_all`` (the row of ``docs``) and ``spans``: the bytes to
    remove. Both joins deal the rows out in one way, so texts are shuffled once."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_all")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(whole_text()).alias("mark"), row)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN_SIZE:  # not a table of files: count
        size = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    buckets = 2 * max(partitions(spark), size // BYTES_PER_BUCKET)
    first = materialise(matched(keyed, buckets, second=False), "suffix-matches")

    def joined(spans: DataFrame, how: str) -> DataFrame:
        spans = spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))  # of one text, once: repeated rows have the same
        return keyed.join(spans.hint("merge"), ["doc_id", "mark"], how)

    again = matched(joined(first.where(~F.col("sure")), "inner"), buckets, second=True)
    sure = first.where("sure").unionAll(again).select("doc_id", "mark", "span")
    return joined(sure, "left")


def removals(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = text.encode()
                removed, n, kept = (0, 0, [(0, len(raw))]) if spans is None else cut(raw, spans)
                digest = hashlib.sha256()
                for a, b in kept:
                    digest.update(raw[a:b])
                rows.append((len(raw), removed, n, digest.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", *out.columns]]

    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = found.select(id_text("_all.doc_id").alias("doc_id"), F.coalesce("_all.text", F.lit("")).alias("text"), "spans")
    out = found.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def remove_repeats(docs: DataFrame, least_left: int = 1) -> DataFrame:
    """The documents with repeated bytes cut out of ``text`` (broken characters at the cuts go too). Documents of
    which under ``least_left`` bytes are left are dropped if anything was removed. Columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, texts = batch.slice(lo, ROWS_AT_ONCE), []
                for text, spans in zip(part.column("_text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    if spans is None:
                        texts.append((True, text))
                        continue
                    raw = text.encode()
                    left = b"".join(raw[a:b] for a, b in cut(raw, spans)[2])
                    texts.append((len(left) >= least_left, left.decode(errors="ignore")))
                new = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts], pa.string()), part.column("_row")], ["_text", "_row"])
                yield new.filter(pa.array([keep for keep, _ in texts], pa.bool_()))

    names = docs.columns
    rest = F.struct(F.lit(0).alias("_"), *[F.col("_all")[c].alias(c) for c in names if c != "text"]).alias("_row")
    rows = with_spans(docs).select(F.col("_all")["text"].cast("string").alias("_text"), rest, "spans")
    out = rows.mapInArrow(run, rows.drop("spans").schema)
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
