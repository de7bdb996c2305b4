"""Spelling variants by Levenshtein automata over compact trie shards.

Words are counted per partition first, so what is shuffled is a word and a number per task, whatever its frequency.
The distinct words, in code-point order, are cut into shards of at most ``SHARD_WORDS`` words and ``SHARD_CHARS`` code
points (a longer word is a shard of its own), each a compact trie: nodes are numbered level by level, the children of
one stand side by side. Shards are broadcast in blocks of ``BLOCK_BYTES``, and every word's automaton for distance one
walks over each shard of a block; when a block is done the next takes its place, so memory does not grow with the
vocabulary.

The automaton's state is (characters of the word read, errors so far). Its one error is placed where the two words
first differ, so each neighbour is accepted on exactly one path and needs no removal of repeats. Many words walk at
once, as arrays, depth first in chunks of ``AT_ONCE`` states. Labels of over ``LONG`` characters are compared whole.

From each block come a word's neighbours as a count and the best of them; blocks are merged by a sum and a minimum.
Roots follow by pointer doubling over the forms: n grows at least fivefold along them, so they have no cycles.

Defined results: a null text has no words; a null ``doc_id`` reads as empty in the hash; repeated rows count each; a
run of any length is a word; an empty table gives no words; further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import discard, id_text, materialise, partitions, release, table, whole_text

SHORTEST, LEAST, TIMES, DROP = 6, 5, 5, 199
SHARD_WORDS, SHARD_CHARS, BLOCK_BYTES = 1 << 17, 1 << 21, 64 << 20
WORDS_AT_ONCE, CHARS_AT_ONCE, AT_ONCE, LONG = 8192, 1 << 20, 1 << 19, 64
#: Distinct words, and their characters, that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 200_000, 1 << 23

#: Runs that are too short to become a word are no match; a longer match is the whole of its run.
RUNS = re.compile(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def document_words(doc_id: str | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a document and how often each occurs; a word may come more than once."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for word, n in Counter(RUNS.findall(text.encode().lower().decode())).items():  # bytes.lower() changes A-Z only
        h = zlib.crc32(word.encode(), start)
        if h % DROP:
            yield word, n
        elif len(word) > SHORTEST:
            yield word[: h % len(word)] + word[h % len(word) + 1 :], n


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n of all words that occur ``least`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for word, n in document_words(doc_id, text):
                    if word not in held:
                        held[word] = 0
                        chars += len(word)
                    held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held, chars = {}, 0
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})
        release()

    source = docs.select(id_text().alias("doc_id"), whole_text().alias("text"))
    return source.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in a row, and where each word begins (and the last ends)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def in_common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class Trie:
    """A compact trie over sorted distinct words. Node v has the label codes[start:start + size], the children first ..
    first + count - 1 in the order of their first characters, and the number of the word that ends there, or -1."""

    FIELDS = (("codes", np.int32), ("begin", np.int64), ("n", np.int64), ("start", np.int64), ("size", np.int32), ("first", np.int32), ("count", np.int32), ("word", np.int32))

    def __init__(self, **fields: np.ndarray):
        for name, _ in self.FIELDS:
            setattr(self, name, fields[name])
        # A child is found by its parent and first character; in the numbering by levels these keys ascend.
        parent = np.repeat(np.arange(len(self.count)), self.count)
        self.keys = parent << 21 | self.codes[self.start[1:]]

    @classmethod
    def of(cls, words: list[str], n: np.ndarray) -> Trie:
        codes, begin = characters(words)
        length = np.diff(begin)
        same = np.array([0, *(in_common(a, b) for a, b in pairwise(words)), 0])
        levels = []
        low, high, depth = np.array([0]), np.array([len(words)]), np.array([0])
        total = 1
        while len(low):
            alone = high - low == 1
            shared = np.minimum.reduceat(same, np.stack([low + 1, high], axis=1).ravel())[::2]
            end = np.where(alone, length[low], shared)
            word = np.where(length[low] == end, low, -1)
            inner = low + (word >= 0)
            members = high - inner
            node = np.repeat(np.arange(len(low)), members)
            at = np.arange(len(node)) - np.repeat(np.cumsum(members) - members, members) + inner[node]
            opens = (at == inner[node]) | (same[at] == end[node])
            owner, child = node[opens], at[opens]
            count = np.bincount(owner, minlength=len(low))
            levels.append((begin[low] + depth, end - depth, total + np.cumsum(count) - count, count, word))
            total += len(child)
            next_high = np.r_[child[1:], 0]
            last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.array([], dtype=bool)
            low, high, depth = child, np.where(last, high[owner], next_high), end[owner]
        parts = [np.concatenate(x) for x in zip(*levels, strict=True)]
        values = dict(zip(("start", "size", "first", "count", "word"), parts, strict=True), codes=codes, begin=begin, n=n)
        return cls(**{name: values[name].astype(kind) for name, kind in cls.FIELDS})

    @classmethod
    def read(cls, row: dict) -> Trie:
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in cls.FIELDS})

    def row(self) -> dict:
        return {name: getattr(self, name).tobytes() for name, _ in self.FIELDS}

    def spelt(self, w: int) -> str:
        return self.codes[self.begin[w] : self.begin[w + 1]].astype("<u4").tobytes().decode("utf-32-le")

    def child(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The child of each node by a first character, or -1."""
        key = node << 21 | c
        at = np.searchsorted(self.keys, key)
        found = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)
        return np.where(found, at + 1, -1)


class Search:
    """Many words' automata on one trie."""

    def __init__(self, trie: Trie, codes: np.ndarray, begin: np.ndarray):
        self.trie, self.codes, self.begin = trie, np.r_[codes, -1, -1], begin[:-1]
        self.length = np.diff(begin)

    def at(self, q: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Character i of each word, -1 behind its end."""
        return np.where(i < self.length[q], self.codes[self.begin[q] + np.minimum(i, self.length[q])], -1)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, number of the trie's word) of all pairs at distance one; each pair comes once."""
        n, t = len(self.length), self.trie
        zero = np.zeros(n, dtype=np.int64)
        stack = [(np.arange(n), zero, zero, zero, zero)]  # word, characters of it read, node, characters of its label read, errors
        while stack:
            q, i, v, k, e = stack.pop()
            if len(q) > AT_ONCE:
                stack += [tuple(x[lo : lo + AT_ONCE] for x in (q, i, v, k, e)) for lo in range(0, len(q), AT_ONCE)]
                continue
            left = t.size[v] - k
            ended, long = left == 0, left > LONG
            following = []
            if ended.any():
                yield from self.accepted(*(x[ended] for x in (q, i, v, e)))
                following += self.branched(*(x[ended] for x in (q, i, v, e)))
            if long.any():
                following += [x for at in np.flatnonzero(long) for x in self.leapt(*(int(x[at]) for x in (q, i, v, k, e)))]
            inside = ~(ended | long)
            if inside.any():
                q, i, v, k, e = (x[inside] for x in (q, i, v, k, e))
                following += self.read(q, i, v, k + 1, e, t.codes[t.start[v] + k])
            following = [x for x in following if len(x[0])]
            if following:
                stack.append(tuple(np.concatenate(x) for x in zip(*following, strict=True)))

    def accepted(self, q, i, v, e) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        word = self.trie.word[v]
        good = (word >= 0) & (i + (e == 0) == self.length[q])  # without an error yet, the word's last character is one too many
        if good.any():
            yield q[good], word[good]

    def branched(self, q, i, v, e) -> list[tuple]:
        """From the end of a label into the children: with an error, only into that of the next character."""
        t, sure = self.trie, e == 1
        q1, i1 = q[sure], i[sure]
        c = self.at(q1, i1)
        child = np.where(c >= 0, t.child(v[sure], np.maximum(c, 0)), -1)
        here = child > 0
        one = np.ones(int(here.sum()), dtype=np.int64)
        out = [(q1[here], i1[here] + 1, child[here], one, one)]
        q0, i0, v0 = q[~sure], i[~sure], v[~sure]
        n = t.count[v0]
        at = np.repeat(np.arange(len(q0)), n)
        child = t.first[v0][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        one = np.ones(len(at), dtype=np.int64)
        return out + self.read(q0[at], i0[at], child, one, one - 1, t.codes[t.start[child]])

    def read(self, q, i, v, k, e, c) -> list[tuple]:
        """The automaton's moves on the trie's next character c: match, or without an error so far replace, insert or
        delete one where the words first differ."""
        now = self.at(q, i)
        same = now == c
        out = [(q[same], i[same] + 1, v[same], k[same], e[same])]
        wrong = np.flatnonzero(~same & (e == 0))
        q, i, v, k, c, now = (x[wrong] for x in (q, i, v, k, c, now))
        one = np.ones(len(q), dtype=np.int64)
        replace, delete = now >= 0, (now >= 0) & (self.at(q, i + 1) == c)
        out.append((q[replace], i[replace] + 1, v[replace], k[replace], one[replace]))
        out.append((q, i, v, k, one))
        out.append((q[delete], i[delete] + 2, v[delete], k[delete], one[delete]))
        return out

    def leapt(self, q: int, i: int, v: int, k: int, e: int) -> list[tuple]:
        """The moves of one state up to the end of a long label, or to where word and label first differ."""
        t, end = self.trie, int(self.trie.size[v])
        label = t.codes[t.start[v] + k : t.start[v] + end]
        word = self.codes[self.begin[q] + i : self.begin[q] + min(i + len(label), int(self.length[q]))]
        differ = np.flatnonzero(label[: len(word)] != word)
        m = int(differ[0]) if len(differ) else len(word)
        one = lambda *x: tuple(np.array([y]) for y in x)
        if m == len(label):
            return [one(q, i + m, v, end, e)]
        if e:
            return []
        return self.read(*one(q, i + m, v, k + m + 1, 0, int(label[m])))


def trie_shards(words: DataFrame) -> DataFrame:
    """One row a shard: a number, its size in bytes and the trie's arrays. Made where the sorted words lie."""

    def made(words: list[str], n: list[int]) -> pd.DataFrame:
        row = Trie.of(words, np.array(n, dtype=np.int64)).row()
        return pd.DataFrame([{"bytes": sum(map(len, row.values())), **row}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, n, chars = [], [], 0
        for batch in batches:
            for word, count in zip(batch["word"], batch["n"], strict=True):
                if words and (len(words) >= SHARD_WORDS or chars + len(word) > SHARD_CHARS):
                    yield made(words, n)
                    words, n, chars = [], [], 0
                words.append(word)
                n.append(count)
                chars += len(word)
        if words:
            yield made(words, n)
        release()

    fields = ", ".join(f"{name} binary" for name, _ in Trie.FIELDS)
    ordered = words.repartitionByRange("word").sortWithinPartitions("word")
    return ordered.mapInPandas(run, f"bytes long, {fields}").withColumn("shard", F.monotonically_increasing_id())


def blocks(shards: DataFrame) -> Iterator[DataFrame]:
    """The shards in runs of ``BLOCK_BYTES`` (or of one larger shard). The driver sees a number and a size a shard."""
    mine, size = [], 0
    for row in shards.select("shard", "bytes").orderBy("shard").toLocalIterator():
        if mine and size + row["bytes"] > BLOCK_BYTES:
            yield shards.where(F.col("shard").isin(mine))
            mine, size = [], 0
        mine.append(row["shard"])
        size += row["bytes"]
    if mine:
        yield shards.where(F.col("shard").isin(mine))


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
    """Words of several batches: the arrays of a search are worth their while for thousands of words."""
    words, chars = [], 0
    for batch in batches:
        for word in batch["word"]:
            words.append(word)
            chars += len(word)
            if len(words) >= WORDS_AT_ONCE or chars >= CHARS_AT_ONCE:
                yield words
                words, chars = [], 0
    if words:
        yield words


def best_of(words: list[str], tries: list[Trie]) -> pd.DataFrame:
    """word, n_near, best_n and best (the near word of largest n, of equal ones the first) against some shards."""
    codes, begin = characters(words)
    near, best_n, best = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.full(len(words), None, dtype=object)
    for t in tries:  # in the order of their words
        for q, w in Search(t, codes, begin).neighbours():
            near += np.bincount(q, minlength=len(words))
            order = np.lexsort((w, -t.n[w], q))
            q, w = q[order], w[order]
            top = np.r_[True, q[1:] != q[:-1]]
            for x, y in zip(q[top].tolist(), w[top].tolist(), strict=True):
                n = int(t.n[y])
                if n >= best_n[x]:
                    spelt = t.spelt(y)
                    if n > best_n[x] or spelt < best[x]:
                        best_n[x], best[x] = n, spelt
    some = near > 0
    return pd.DataFrame({"word": np.array(words, dtype=object)[some], "n_near": near[some], "best_n": best_n[some], "best": best[some]})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best of every word that has a near one."""
    spark = words.sparkSession
    shards = materialise(trie_shards(words), "spelling-shards")
    found = []
    for block in blocks(shards):
        shared = spark.sparkContext.broadcast([{name: bytes(r[name]) for name, _ in Trie.FIELDS} for r in block.orderBy("shard").collect()])  # BLOCK_BYTES

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tries = [Trie.read(x) for x in shared.value]
            for part in gathered(batches):
                yield best_of(part, tries)
            release()

        found.append(materialise(words.select("word").mapInPandas(run, "word string, n_near long, best_n long, best string"), "spelling-near"))
        shared.unpersist()  # the next block takes its place
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(0).cast("long").alias("best_n"), F.lit("").alias("best")).limit(0)
    near = found[0]
    for more in found[1:]:
        near = near.unionAll(more)
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t"))
    near = materialise(near.select("word", "n_near", (-F.col("t.n")).alias("best_n"), F.col("t.w").alias("best")), "spelling-best")
    discard(shards, *found)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of the chain word -> form -> its form .., by pointer doubling."""
    root = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = root.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        further = materialise(further, "spelling-roots")
        moved = not further.where("_moved").isEmpty()
        discard(root)
        root = further.drop("_moved")
        root._written_to = further._written_to
        if not moved:
            return root


def variants(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words; a form occurs at least ``times`` as often as the word."""
    words = materialise(word_counts(docs, least).repartition(partitions(docs.sparkSession)), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    good = F.col("best_n") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    near = materialise(near, "spelling-forms")
    root = roots(near.where(F.col("form").isNotNull()))
    return near.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
