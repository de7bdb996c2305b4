"""Filter interaction audit by the multilinear extension of Shapley's value.

Each document fails a set of filters, its mask. For one part of the corpus the masks' counts give the removal
polynomial: in x_A .. x_E (how likely each filter runs) it is the sum over masks of count x (1 - product of (1 - x_i)
over the mask), the expected number of removed documents. Its value at a corner is what a set of filters removes, so
every step of every order comes from two corners. The integral over t of the partial derivative by x_i at (t, .., t) is
the filter's Shapley value; it is taken with exact rationals and scaled by the number of orders.

Marking is map-only. Whether a text stood at a smaller id already is found by aggregating the least id per text digest
(BLAKE2, 128 bits) and joining it back by digest *and* id, so a text that fills a third of the table spreads over its
ids. What reaches one group is a part's counts: 4 x 2^filters rows at most.

Defined results: a null text is empty, a null source the part ''; rows with a null ``doc_id`` are counted, never fail E
and make no other row fail it; repeated rows count each and do not fail E through one another; a label counts as set if
any of its rows says so; an empty table gives no parts; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, materialise, release, table, whole_text

FILTERS = "ABCDE"
SMALL, SYMBOLS = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), re.compile(r"[#$%&*|]")


def failures(text: str) -> int:
    """The filters of one text, A to D, that it fails, as bits."""
    data = text.encode()
    found = data.split()  # of bytes: cuts at exactly 09-0D and 20
    capitals = len(data.translate(None, SMALL))
    return (len(found) < 50) | (100 * len(set(found)) < 65 * len(found)) << 1 | (100 * capitals > 5 * len(text)) << 2 | bool(SYMBOLS.search(text)) << 3


class Multilinear:
    """A polynomial in which no variable has a power above one: coefficients by the set of variables, as bits."""

    def __init__(self, n: int, coefficients: list[int]):
        self.n, self.coefficients = n, coefficients

    @classmethod
    def removal(cls, n: int, counts: dict[int, int]) -> Multilinear:
        """Documents removed, from the number of documents that fail exactly a set of filters."""
        above = [counts.get(s, 0) for s in range(1 << n)]
        for i in range(n):  # above[s]: documents that fail at least s
            for s in range(1 << n):
                if not s >> i & 1:
                    above[s] += above[s | 1 << i]
        return cls(n, [0, *(above[s] if s.bit_count() % 2 else -above[s] for s in range(1, 1 << n))])

    def corner(self, s: int) -> int:
        """The value where the variables of ``s`` are one and the others zero."""
        return sum(c for t, c in enumerate(self.coefficients) if not t & ~s)

    def derivative(self, i: int) -> Multilinear:
        return Multilinear(self.n, [0 if s >> i & 1 else self.coefficients[s | 1 << i] for s in range(1 << self.n)])

    def diagonal_integral(self) -> Fraction:
        """The integral over t from 0 to 1 where all variables are t."""
        return sum((Fraction(c, s.bit_count() + 1) for s, c in enumerate(self.coefficients)), Fraction(0))


def audited(part: str, masks: pd.DataFrame, filters: str) -> pd.DataFrame:
    """The rows of one part, from its counts by _mask, _good, _toxic."""
    n = len(filters)

    def polynomial(rows: pd.DataFrame) -> Multilinear:
        return Multilinear.removal(n, {int(m): int(c) for m, c in rows.groupby("_mask")["_n"].sum().items()})

    removal, good, toxic = polynomial(masks), polynomial(masks[masks["_good"]]), polynomial(masks[masks["_toxic"]])
    total, full = int(masks["_n"].sum()), (1 << n) - 1
    fails = [removal.corner(1 << i) for i in range(n)]
    alone = [removal.corner(full) - removal.corner(full & ~(1 << i)) for i in range(n)]
    values = [removal.derivative(i).diagonal_integral() * factorial(n) for i in range(n)]
    out = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = removal.corner(after) - removal.corner(before)
            lost = [p.corner(after) - p.corner(before) for p in (good, toxic)]
            out.append((part, "".join(filters[k] for k in order), step, filters[i], total - removal.corner(after), removed, fails[i] - removed, alone[i], *lost, int(values[i])))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


RESULT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def marked(docs: DataFrame) -> DataFrame:
    """_id, part, _fails (A to D as bits) and _text (digest) of every row. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fails = [failures(t) for t in batch["text"]]
            digest = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "part": batch["part"], "_fails": fails, "_text": digest})
        release()

    source = docs.select(id_text().alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    return source.mapInPandas(run, "_id string, part string, _fails int, _text binary").withColumn("_id", F.col("_id").cast("long"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, _mask (failed filters as bits, E the fifth), _good, _toxic and how many documents (_n)."""
    rows = materialise(marked(docs), "audit-marked")
    first = rows.where(F.col("_id").isNotNull()).groupBy("_text").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    again = (F.col("_id").isNotNull() & F.col("_first").isNull()).cast("int")
    held = rows.join(first, ["_text", "_id"], "left").select("_id", "part", (F.col("_fails") + 16 * again).alias("_mask")).join(said, "_id", "left")
    no = F.lit(False)
    return held.groupBy("part", "_mask", F.coalesce("_good", no).alias("_good"), F.coalesce("_toxic", no).alias("_toxic")).agg(F.count(F.lit(1)).alias("_n"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps of every part, from counts as ``mask_counts`` gives them. A mask's bit i is the filter
    ``filters[i]``; a part is one small group."""
    return counts.groupBy("part").applyInPandas(lambda key, rows: audited(key[0], rows, filters), RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: The same from the definitions: every order walks over the masks, and a document's share of an order is counted as
#: 120 / (filters it fails), which is how often each of them comes first.
OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
cut AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY body) AS first_id FROM texts),
marks AS (
  SELECT part,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::INT
    + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM cut LEFT JOIN labels l USING (doc_id)),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM marks GROUP BY ALL),
letters AS (SELECT i, substr('ABCDE', i + 1, 1) AS c FROM range(5) r(i)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, (1 << places[step]) AS own,
    (CASE WHEN step > 1 THEN 1 << places[1] ELSE 0 END) + (CASE WHEN step > 2 THEN 1 << places[2] ELSE 0 END)
    + (CASE WHEN step > 3 THEN 1 << places[3] ELSE 0 END) + (CASE WHEN step > 4 THEN 1 << places[4] ELSE 0 END) AS earlier
  FROM orders, range(1, 6) s(step))
SELECT part, filter_order, step::INT AS step, filter,
  sum(CASE WHEN mask & (earlier + own)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps GROUP BY ALL
"""
