"""Spelling variants against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n long, form string, root string, shard string"


def at_distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least=5, times=5):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [x for x in counts if at_distance_one(w, x)]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    stems = ["abcdef", "ABCDEF", "abcdéf", "abcdÉf", "color×x", "letters", "lettersx", "öffnung", "aaaaaaa", "aaaaaaaa", "a" * 300, "a" * 301, "b" + "a" * 300, "q" * 5, "short"]
    weight = [300, 40, 9, 6, 8, 60, 11, 20, 50, 9, 6, 30, 6, 9, 9]
    texts = []
    for _ in range(n):
        words = rng.choices(stems, weight, k=rng.randint(0, 30))
        words = [w[: (k := rng.randrange(len(w)))] + rng.choice("abcxé") + w[k + rng.randint(0, 1) :] if rng.random() < 0.3 else w for w in words]
        texts.append(rng.choice([" ", "-", "1", "ā", "\n"]).join(words))
    texts += [None, "", " ", "12345", "abcdef" * 5000]
    docs = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (None, None), (-7, texts[5])]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "w", 1, "f", "r", "s") for i, t in docs], SCHEMA)


def test_variants_equal_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] == 0 for r in want) and any("é" in r[0] for r in want)
    assert sorted(map(tuple, sp.variants(frame(spark, docs)).collect()), key=lambda r: r[0]) == want
    for name, value in {"SHARD_WORDS": 40, "BLOCK_BYTES": 6000, "HELD_WORDS": 30, "WORDS_AT_ONCE": 25, "AT_ONCE": 64, "LONG": 3}.items():
        monkeypatch.setattr(sp, name, value)  # the sizes of shards, blocks and chunks change the plan, not the result
    blocks = list(sp.blocks(sp.trie_shards(spark.createDataFrame([(r[0], r[3]) for r in want], "word string, n long")).cache()))
    assert len(blocks) > 2


@pytest.mark.parametrize("sizes", [{}, {"LONG": 2}, {"AT_ONCE": 40, "LONG": 1}])
def test_automata_accept_exactly_the_near_words(monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(sp, name, value)
    rng = random.Random(5)
    for _ in range(8):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) + "z" * rng.choice([0, 0, 90]) for _ in range(150)})
        trie = sp.Trie.read(sp.Trie.of(words, np.ones(len(words), dtype=np.int64)).row())
        asked = [*words, "", "abc", "zzzz"]
        got = sorted((int(a), int(b)) for q, w in sp.Search(trie, *sp.characters(asked)).neighbours() for a, b in zip(q, w, strict=True))
        assert got == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if at_distance_one(a, b)]
        assert [trie.spelt(i) for i in range(len(words))] == words


def test_blocks_of_shards_merge_to_the_same_result():
    """A worker's part of the job, with one shard or many."""
    want = brute(corpus(2, 200))
    words, n = [r[0] for r in want], np.array([r[3] for r in want])
    whole = sp.best_of(words, [sp.Trie.of(words, n)])
    cut = sp.best_of(words, [sp.Trie.of(words[lo : lo + 9], n[lo : lo + 9]) for lo in range(0, len(words), 9)])
    assert whole.equals(cut) and {r.word: r.n_near for r in whole.itertuples()} == {r[0]: r[4] for r in want if r[4]}


def test_no_words(spark):
    assert sp.variants(frame(spark, [])).collect() == []
    assert sp.variants(frame(spark, [(1, None), (None, "too short words only")])).collect() == []
    assert [tuple(r) for r in sp.variants(frame(spark, [(1, "lonely " * 5)])).collect()] == brute([(1, "lonely " * 5)])
