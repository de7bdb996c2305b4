"""A hash tree that follows changes equals one built anew."""

import random

from lakeloom.operators import hash_tree
from lakeloom.operators.reconcile import Rule

RULES = {"k": Rule("int"), "v": Rule("text"), "m": Rule("decimal")}
SCHEMA = "k long, v string, m decimal(12,2)"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, None) for k, v in rows.items()], SCHEMA)


def state(tree):
    rows = sorted(map(tuple, tree.rows().collect()))
    return rows, sorted(map(tuple, tree.levels().select("level", "segment", "n_rows", "h1", "h2").collect()))


def test_a_night_hashes_its_changes_only(spark, tmp_path):
    rng = random.Random(1)
    old = {k: f"v{rng.randrange(100)}" for k in range(4000)} | {-1: None, -2: "a|b\\"}
    first = hash_tree.build(frame(spark, old), ["k"], RULES, str(tmp_path / "a"))
    assert first.n_hashed == len(old)
    changed = {k: "new" for k in rng.sample(sorted(old), 12)} | {9000: "added", 9001: None}
    gone = [k for k in rng.sample(sorted(old), 9) if k not in changed] + [777_777]
    second = hash_tree.advance(first, frame(spark, changed), spark.createDataFrame([(k, "x") for k in gone], "k long, other string"), ["k"], RULES)
    assert second.n_hashed == len(changed)
    now = {k: v for k, v in (old | changed).items() if k not in gone}
    assert state(second) == state(hash_tree.build(frame(spark, now), ["k"], RULES, str(tmp_path / "b")))
    shared = set(first.parts.values()) & set(second.parts.values())
    assert len(shared) >= len(first.parts) - len(changed) - len(gone)
    want = {(str(k), "missing") for k in gone if k in old} | {(str(k), "changed" if k in old else "extra") for k in changed}
    assert {tuple(r) for r in hash_tree.differing(first, second).collect()} == want
    assert state(first)[0] == state(hash_tree.build(frame(spark, old), ["k"], RULES, str(tmp_path / "c")))[0]  # the old night is still there


def test_quiet_nights_and_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    empty = hash_tree.build(none, ["k"], RULES, str(tmp_path / "e"))
    assert hash_tree.differing(empty, empty).collect() == [] and empty.n_hashed == 0
    one = hash_tree.advance(empty, frame(spark, {1: "x"}), none.select("k"), ["k"], RULES)
    assert {tuple(r) for r in hash_tree.differing(empty, one).collect()} == {("1", "extra")}
    same = hash_tree.advance(one, frame(spark, {1: "x"}), none.select("k"), ["k"], RULES)
    assert hash_tree.differing(one, same).collect() == []
    back = hash_tree.advance(one, none, spark.createDataFrame([(1,)], "k long"), ["k"], RULES)
    assert back.levels().count() == 0 and back.rows().count() == 0
