"""MinHash near-duplicates against comparing all sets with all sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import minhash as mh

SCHEMA = "doc_id long, text string, _n long, _bucket string, component_id string, kept string, _root string"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if len(w) == 1 else {tuple(w[i : i + 2]) for i in range(len(w) - 1)}


def brute(docs):
    sets, parent = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if top(j) == top(i) and docs[j][0] is not None]
        c = d if not sets[i] else min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def texts(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for t in out[:40]:  # near copies around the limit, some in chains
        for _ in range(3):
            w = t.split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
            out.append(t)
    template = [rng.choice(words) for _ in range(40)]
    out += [" ".join(template + [rng.choice(words) for _ in range(14)]) for _ in range(70)]  # alike, mostly not alike enough
    out += ["a b c d e f", "a b c d e", "a b c d e f g", "x y", "X\tY", "x", "x x", "x x x", "one", "One ", "b c a", out[0].upper(), out[0] + " " + out[0]]
    return out + [None, "", " \n", "naïve É é"] * 2


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x", "y", "z", "r") for d, t in docs], SCHEMA)


def cases(seed=1):
    found = texts(seed)
    docs = list(enumerate(found)) + [(5, found[5]), (5, found[5]), (None, found[6]), (None, "quite alone here"), (None, None), (-3, found[70])]
    random.Random(seed).shuffle(docs)
    return docs


def test_components_equal_brute_force(spark):
    docs = cases()
    assert sorted(map(tuple, mh.near_duplicates(frame(spark, docs)).collect()), key=str) == brute(docs)


@pytest.mark.parametrize("many", [4, 4096])
def test_large_clusters_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(mh, "SMALL", 3)
    monkeypatch.setattr(mh, "BLOCK", 4)
    monkeypatch.setattr(mh, "MANY", many)
    monkeypatch.setattr(mh, "MAP_BITS", 1 << 5)
    docs = cases(2)
    assert sorted(map(tuple, mh.near_duplicates(frame(spark, docs)).collect()), key=str) == brute(docs)


def test_pairs_within_the_distance_meet(spark):
    """Every pair of signatures that differ at up to 2 x CHUNKS - 1 positions has a bucket."""
    rng = np.random.default_rng(1)
    n = mh.CHUNKS * mh.WIDTH
    base = rng.integers(0, 1 << 16, (40, n))
    other = base.copy()
    for k, row in enumerate(other):
        row[rng.choice(n, k % (2 * mh.CHUNKS), replace=False)] += 1
    rows = [(i, i, s.tolist()) for i, s in enumerate(np.concatenate([base, other]))]
    keys = spark.createDataFrame(rows, "i long, _n long, _sig array<int>").select("i", mh.chunk_keys().alias("k")).collect()
    keys = {r.i: set(r.k) for r in keys}
    assert all(keys[i] & keys[i + 40] for i in range(40))
    assert not keys[0] & keys[1]


def test_prefixes_share_a_shingle(spark):
    sets = [[*range(10)], [*range(1, 11)], [*range(2, 12)], [*range(100, 140)], [*range(104, 144)]]
    rows = [(1, i, len(s), s) for i, s in enumerate(sets)]
    large = spark.createDataFrame([r[:3] for r in rows], "_bucket long, _n long, _size long")
    again = mh.refiled(large, spark.createDataFrame([(r[1], r[3]) for r in rows], "_n long, _set array<long>"))
    met = {tuple(sorted(x)) for r in again.groupBy("_bucket").agg(F.collect_set("_n").alias("n")).collect() for x in [(a, b) for a in r.n for b in r.n if a < b]}
    assert {(0, 1), (1, 2), (3, 4)} <= met and not any(a < 3 <= b for a, b in met)


def test_empty(spark):
    assert mh.near_duplicates(frame(spark, [])).collect() == []
    assert list(map(tuple, mh.near_duplicates(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
