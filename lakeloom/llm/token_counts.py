"""Token counts by prefix dynamic programming.

A byte-level BPE text falls into pieces that never influence each other. For one piece of bytes ``b`` let
``last[j]`` be the last token of the encoding of ``b[:j]``. It is the only vocabulary entry ``t`` that ends at
``j`` and may stand after ``last[j - len(t)]``, so ``count[j] = count[j - len(t)] + 1`` follows from shorter
prefixes. One pass thus stores the exact count of *every* prefix, and questions about truncation or a budget are
look-ups. Two tokens may stand side by side if encoding their joined bytes gives the same two back; the answer
is remembered per pair.

Words repeat, so each process keeps the counts of the chunks it met (``CACHE_CHUNKS`` at most, then it starts
afresh: only speed depends on it). A chunk is a stretch between single spaces that have a visible character on
both sides; a piece never crosses such a place. Long texts are handled chunk by chunk.

Defined results: a null text counts as empty (0 tokens); repeated rows are counted each; a null ``doc_id`` is
kept; further columns do not matter. The special string of the vocabulary counts as one token wherever it stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, only, release, table, whole_text

LIMIT = 1024
CACHE_CHUNKS = 700_000
VOCABULARY = "byte_bpe_50k.json"

#: How this vocabulary's library cuts a text into pieces, and the printable stand-ins of bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())
SPACES = regex.compile(r"\s+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CUTS = re.compile(r"(?<=\S) (?=\S)")
BESIDE_SPACE = re.compile(r"\s\s|^\s|\s$")
LONG_PIECE = 100


def chunks(text: str) -> list[str]:
    """Cut at every single space between two visible characters."""
    return CUTS.split(text) if BESIDE_SPACE.search(text) else text.split(" ")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    stands = {b: chr(b) for b in PRINTABLE}
    for b in range(256):
        stands.setdefault(b, chr(256 + sum(x >= 256 for x in map(ord, stands.values()))))
    return [stands[b] for b in range(256)]


class PrefixCounter:
    """Exact token counts of a text and of all its prefixes."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        model = spec["model"]
        self.vocabulary = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.longest: dict[bytes, int] = {}  # of the tokens that end in some two bytes
        for t in self.vocabulary:
            self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 0))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(bytes(back[c] for c in a), bytes(back[c] for c in b)): k for k, (a, b) in enumerate(pairs)}
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[bytes, int]] = {}
        self.after_space: dict[str, int] = {}
        self.cache_chunks = cache_chunks

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether encoding the joined bytes of two tokens gives the two tokens.

        Walk back in time, undoing the later of the two merges that made the touching fragments. The border is
        lost if, while two fragments stood side by side, a merge of the two came before the next growth of
        either (of equal merges the leftmost comes first)."""
        known = self.beside.get((a, b))
        if known is not None:
            return known
        key, rank, made = (a, b), self.rank, self.made
        left_grows = right_grows = 1 << 60
        known = True
        while True:
            joins = rank.get((a, b))
            if joins is not None and joins < left_grows and joins <= right_grows:
                known = False
                break
            of_left, of_right = made.get(a), made.get(b)
            if of_left is None and of_right is None:
                break
            if of_right is None or of_left is not None and of_left[0] > of_right[0]:
                left_grows, _, a = of_left
            else:
                right_grows, b, _ = of_right
        if len(self.beside) >= self.cache_chunks:
            self.beside.clear()
        self.beside[key] = known
        return known

    def piece_prefixes(self, data: bytes) -> list[int]:
        """``count[j]`` for every prefix ``data[:j]`` of one piece."""
        vocabulary, longest, may_follow = self.vocabulary, self.longest, self.may_follow
        last: list[bytes] = [b""]
        count = [0]
        for j in range(1, len(data) + 1):
            for i in range(max(0, j - longest.get(data[j - 2 : j], 1)) if j > 1 else 0, j):
                t = data[i:j]
                if t in vocabulary and (not i or may_follow(last[i], t)):
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def _state(self, data: bytes) -> tuple[bytes, int]:
        """Last token and count of the encoding of ``data``, from those of its prefixes. Words share prefixes,
        so the states are kept across words."""
        state = self.states.get(data)
        if state is None:
            if len(data) > LONG_PIECE:
                return b"", self.piece_prefixes(data)[-1]
            vocabulary, n = self.vocabulary, len(data)
            for i in range(max(0, n - self.longest.get(data[-2:], 1)), n):
                t = data[i:]
                if t in vocabulary:
                    before = self._state(data[:i]) if i else (b"", 0)
                    if not i or self.may_follow(before[0], t):
                        state = (t, before[1] + 1)
                        break
            if len(self.states) >= self.cache_chunks:
                self.states.clear()
            self.states[data] = state
        return state

    def piece(self, data: bytes) -> int:
        return self._state(data)[1]

    def chunk(self, chunk: str) -> int:
        return sum(self.piece(p.encode()) for p in PIECES.findall(chunk))

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Counts at every character of a chunk, in one pass. A prefix falls into the pieces of the whole but in two
        places: inside a contraction it is counted by itself, and white space at its end is one piece, while in the
        whole the last blank of a run is a piece of its own or begins a word."""
        out, base, after = [0], 0, None
        for m in PIECES.finditer(chunk):
            piece, follows = m.group(), chunk[m.end() : m.end() + 1]
            blank = SPACES.fullmatch(piece) and SPACES.match(follows)  # a run of white space goes on by one character
            if piece in CONTRACTIONS:
                found = [self.chunk(piece[:k]) for k in range(1, len(piece) + 1)]
            else:
                counts = self.piece_prefixes((piece + follows if blank else piece).encode())
                found = [counts[at] for at in accumulate(len(c.encode()) for c in piece)]
            begins = len(out)
            out += [base + n for n in found]
            if after is not None:
                out[begins] = after
            after = base + counts[-1] if blank else None
            base += found[-1]
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Independent stretches of a text, in order; True marks a special string."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _learn(self, word: str) -> int:
        if len(self.after_space) >= self.cache_chunks:
            self.after_space.clear()
        n = self.after_space[word] = self.chunk(" " + word)
        return n

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.parts(text) if any(s in text for s in self.special) else ((text, False),):
            if special:
                total += 1
            elif part:
                first, *rest = chunks(part)
                found = list(map(self.after_space.get, rest, repeat(-1)))
                total += self.chunk(first) + sum(found)
                if -1 in found:
                    total += sum(1 + (self.after_space.get(w) or self._learn(w)) for w, n in zip(rest, found, strict=True) if n < 0)
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of ``text[:j]`` for every ``j`` that does not cut a special string (-1 there)."""
        out, base = [0], 0
        for part, special in self.parts(text):
            if special:
                out += [-1] * (len(part) - 1) + [base + 1]
                base += 1
                continue
            for k, chunk in enumerate(chunks(part)):
                counts = self.chunk_prefixes(" " * (k > 0) + chunk)
                out += [base + n for n in counts[1:]]
                base += counts[-1]
        return np.array(out, dtype=np.int64)

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        at = best = base = 0
        for part, special in self.parts(text):
            if special:
                base += 1
                at += len(part)
                best = at if base <= budget else best
                continue
            for k, chunk in enumerate(chunks(part)):
                whole = " " * (k > 0) + chunk
                n = (self.after_space.get(chunk) or self._learn(chunk)) if k else self.chunk(whole)
                if base + n <= budget:
                    best = at + len(whole)
                elif base < budget:
                    fits = [j for j, c in enumerate(self.chunk_prefixes(whole)) if base + c <= budget]
                    best = max(best, at + fits[-1])
                base += n
                at += len(whole)
            if base > budget:
                break
        return best


def counter(path: str | None = None) -> PrefixCounter:
    """This process's counter of a vocabulary file, by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return only(("prefix counter", path), lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and cut_chars, the characters of the longest prefix
    of at most ``limit`` tokens (all, if the text fits). Map-only: nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for batch in batches:
            tokens = [c.count(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": [len(t.encode()) for t in batch["text"]],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                    "cut_chars": [c.cut(t, limit) if n > limit else len(t) for t, n in zip(batch["text"], tokens, strict=True)],
                }
            )
        release()

    source = docs.select(id_text().alias("doc_id"), whole_text().alias("text"))
    out = source.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
