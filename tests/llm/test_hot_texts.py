"""Texts that repeat one thing over and over, against brute force and against the clock."""

import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeloom.llm import decontamination, suffix_dedup, token_counts


def overlaps(docs, items):
    """(doc, item) -> (first word, windows at the best shift)."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = {}
    for d, t in docs:
        for i, b in items:
            w, b = words(t), words(b)
            size = min(13, len(b))
            for shift in range(1 - len(b), len(w)):
                lo, hi = max(0, -shift), min(len(b), len(w) - shift)
                equal = [w[q + shift] == b[q] for q in range(lo, hi)]
                need = 11 if size == 13 else size
                good = [k for k in range(len(equal) - size + 1) if sum(equal[k : k + size]) >= need] if len(b) >= 5 else []
                if good:
                    first, n = out.get((d, i), (10**9, 0))
                    out[d, i] = (min(first, lo + shift + good[0]), max(n, len(good)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"most_hashes": 0}, {"most_found": 0}])
def test_decontamination_of_repeated_words(spark, sizes):
    rng = random.Random(4)
    some = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    docs = [(0, "word " * 120), (1, "a b " * 60), (2, some(90, "abc")), (3, some(200, "ab")), (4, "x " * 7 + some(30, "pqrst")), (5, "word " * 30 + some(40, [f"w{k}" for k in range(30)]))]
    docs += [(6, docs[2][1]), (6, docs[2][1]), (7, None), (8, "word " * 12), (9, "word " * 4)]
    items = [(0, "word " * 60), (1, "b a " * 20), (2, some(40, "abc")), (3, "x x x x x x"), (4, some(25, [f"w{k}" for k in range(30)])), (5, some(14, "ab")), (6, "word " * 12)]
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **sizes).collect()
    want = overlaps(docs, items)
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_windows) for r in got} == want and len(got) == len(want) == 9


def test_decontamination_of_a_long_junk_document(spark):
    docs = spark.createDataFrame([(0, "word " * 3000), (1, "a b c " * 1000), (2, "word")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(0, "word " * 300), (1, "c a b " * 100)], "item_id long, text string")
    decontamination.overlaps(docs.where("doc_id = 2"), items).collect()
    began = time.perf_counter()
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, items).collect()} == {(0, 0), (1, 1)}
    assert time.perf_counter() - began < 60


def test_prefixes_beside_white_space_and_quotes():
    tokenizer, c, rng = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY)), token_counts.counter(), random.Random(8)
    parts = [" ", "  ", "\n", "\t", "\r\n", "　", "\x1c", "\x85", "'", "''", "'s", "'r", "'re", "'ll", "'t", "s", "rest", "a", "é", "1", "!"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [len(tokenizer.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
        assert c.prefixes(text).tolist() == want, text
        budget = rng.randint(0, want[-1] + 1)
        assert want[c.cut(text, budget)] <= budget and all(n > budget for n in want[c.cut(text, budget) + 1 :])


@pytest.mark.parametrize("text", ["word " * 10 + "\n \t" * 33_000 + "x", " " * 100_000, "a" + "\n" * 100_000 + "b", "'" * 100_000, "x " + "'" * 50_000 + "s", "é" * 50_000])
def test_cutting_junk_is_linear(text):
    c = token_counts.counter()
    began = time.perf_counter()
    at = c.cut(text, 200)
    assert 0 < at <= len(text)
    assert time.perf_counter() - began < 10  # a shared machine; the time per character does not grow


def test_many_repeated_rows_share_one_list_of_spans(spark):
    passage = "the same sixty bytes and more that every single row repeats: " * 2
    docs = [(1, passage + "first"), *[(7, f"{passage}row")] * 400, (9, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [r for r in suffix_dedup.removals(df).collect() if r.doc_id == 7]
    assert len(got) == 400 and len(set(got)) == 1 and got[0].n_removed == len(passage) and got[0].n_spans == 1
    spans = [r.spans for r in suffix_dedup.with_spans(df).collect() if r.spans is not None]
    assert max(map(len, spans)) < 10
