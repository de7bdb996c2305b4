"""The filter audit against filters that run one after another."""

import random
import re
from itertools import permutations

from lakeloom.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, part string, _mask long, _n string"


def brute(docs, labels):
    """(part, order, step) -> (kept, removed, redundant, unique, good, toxic, shapley); ``docs``: id, text, source."""
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = [x for x in labels if x[0] is not None and x[0] == i]
        known = [
            len(w) < 50,
            100 * len(set(w)) < 65 * len(w),
            100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        ]
        fails.append((s or "", {c for c, x in zip("ABCDE", known, strict=True) if x}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(gone)
                redundant = sum(c in x[1] for x in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {c} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def got(spark, docs, labels):
    rows = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, _good string")
    out = fa.audit(fa.mask_counts(rows, labels)).collect()
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in out)
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}


def test_all_orders_equal_filters_in_sequence(spark):
    rng = random.Random(3)
    words = ["the", "And", "of$", "ZZ", "é x", *(f"w{i}" for i in range(80))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 49, 50, 60, 120]))) for _ in range(60)]
    texts = [t.lower() if rng.random() < 0.5 else t for t in texts] + [None, "", " ", "\x0b\x1f\x1c", "x" * 5000, "a b", "A"]
    docs = [(i, t, rng.choice(["s", "t", None, ""])) for i, t in enumerate(texts * 2)]
    docs += [docs[5], docs[5], (None, texts[0], "s"), (None, texts[0], "t"), (-4, texts[3], "u"), (7, texts[1], "s")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for d, _, _ in docs if rng.random() < 0.6] + [(5, 1, 1, "x"), (None, 1, 1, "x")]
    want = brute(docs, labels)
    assert got(spark, docs, labels) == want
    assert {k[0] for k in want} == {"", "s", "t", "u"} and len(want) == 4 * 600


def test_no_documents_no_parts(spark):
    assert got(spark, [], []) == {}
    assert set(map(tuple, got(spark, [(1, None, None)], []).values())) == {(0, 1, 0, 1, 0, 0, 120), (0, 0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0)}


def test_polynomial_is_exact():
    p = fa.Multilinear.removal(2, {0: 5, 1: 2, 3: 7})
    assert [p.corner(s) for s in range(4)] == [0, 9, 7, 9]
    assert [p.derivative(i).diagonal_integral() * 2 for i in range(2)] == [11, 7]
