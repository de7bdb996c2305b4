"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. The hidden state of a line is its speaker (system, user, assistant) and
whether it opens a turn or goes on; observed are the speaker marker at its head (if any), its length, a closing
question mark, and emptiness. Counts over labelled turns give the start, transition and emission probabilities
(add-one smoothing); they are a few dozen numbers whatever the table holds. Viterbi recovers the likeliest states.

A long conversation is cut into blocks of ``BLOCK_TURNS`` source turns. Each block is reduced to its 6 x 6 matrix of best path
weights (maximum and sum form a semiring), a conversation's matrices are chained to fix the states at block
borders, and each block is then traced between its border states: the path is that of the whole conversation,
but no task holds more than blocks. Turns are rendered as ``<|role|>``, text, ``<|end|>``;
a marker at the head goes if it names the role that the model found, and is text otherwise.

Defined results: a null text counts as empty (one empty line); equal rows are one turn of the source and kept once;
rows of equal ``turn`` follow each other by text; a null ``conv_id`` is one conversation, a null ``turn`` comes
first; rows whose role is not one of the three don't train; an empty table gives an empty result; further columns
do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm._util import id_text, materialise, partitions, table, whole_text

ROLES = ("system", "user", "assistant")
STATES = [(r, opens) for r in range(3) for opens in (True, False)]
BLOCK_TURNS = 64
LINES_PER_BUCKET = 200_000
#: Of so many conversations (by hash) one does not train, so that it can grade.
HELD_OUT = 5
#: Names that markers use for the roles, and the forms of a marker.
NAMES = {"system": 0, "sys": 0, "instruction": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "model": 2}
MARKER = r"^\s*(?:#{1,6}\s*|\[|<\|?|\*\*)?([A-Za-z]{1,12})\s*(?:\]|\|?>|:?\*\*:?|:)\s*"
STYLES = (("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### AI: "), ("[system] ", "[human] ", "[bot] "))
LENGTHS = 8
CODES = 4 * LENGTHS * 2


def transcripts(conversations: DataFrame, unmarked: int = 4) -> DataFrame:
    """Raw transcripts from labelled turns: every conversation in one marker style, one turn in ``unmarked`` without
    a marker. Columns conv_id, turn, role, text."""
    names = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce("role", F.lit(""))).cast("int")
    style = F.get(names, F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int"))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0) | (role == 0)
    text = F.when(bare, whole_text()).otherwise(F.concat(F.get(style, role - 1), whole_text()))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))


def observed(line: Column) -> Column:
    """The observation code of a line: marker (none, or a role), length class, question mark."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v + 1))])
    marker = F.coalesce(F.element_at(names, name), F.lit(0))
    size = F.length(F.trim(line))
    length = F.least(F.lit(LENGTHS - 1), F.when(size == 0, 0).otherwise(1 + F.floor(F.log2(size.cast("double")) / 1.5)))
    asks = F.rtrim(line).endswith("?").cast("int")
    return (marker * 2 * LENGTHS + length * 2 + asks).cast("int")


class Model:
    """Logarithms of the start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        def log(x: np.ndarray) -> np.ndarray:
            return np.log(x / x.sum(axis=-1, keepdims=True))

        opens = np.array([o for _, o in STATES])
        role = np.array([r for r, _ in STATES])
        self.start = np.where(opens, log(np.where(opens, start + 1, 1e-300)), -1e18)
        possible = opens[None, :] | (role[:, None] == role[None, :])  # a line goes on only in its own role
        self.step = np.where(possible, log(np.where(possible, step + 1, 1e-300)), -1e18)
        parts = emit.reshape(len(STATES), 4, LENGTHS, 2)
        features = [parts.sum(axis=(2, 3)), parts.sum(axis=(1, 3)), parts.sum(axis=(1, 2))]
        a, b, c = (log(f + 1) for f in features)
        self.emit = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(len(STATES), CODES).T.copy()

    def weights(self, codes: np.ndarray) -> np.ndarray:
        """Best path weight from each state before the lines to each state of the last line."""
        best = self.step + self.emit[codes[0]]
        for code in codes[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + self.emit[code]
        return best

    def trace(self, codes: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
        """The best states of the lines, given the state before (None: the start) and of the last line (None: any)."""
        score = (self.start if before is None else self.step[before]) + self.emit[codes[0]]
        back = np.empty((len(codes), len(STATES)), dtype=np.int8)
        for i, code in enumerate(codes[1:], 1):
            reach = score[:, None] + self.step
            back[i] = reach.argmax(axis=0)
            score = reach.max(axis=0) + self.emit[code]
        path = np.empty(len(codes), dtype=np.int8)
        path[-1] = score.argmax() if last is None else last
        for i in range(len(codes) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def lines(turns: DataFrame) -> DataFrame:
    """conv_id, turn, _nth (order among rows of equal turn: the text's hash), _at, line, code."""
    rows = turns.select("conv_id", "turn", "text").distinct()
    return rows.select("conv_id", "turn", F.xxhash64("text").alias("_nth"), F.posexplode(F.split("text", "\n")).alias("_at", "line")).withColumn("code", observed(F.col("line")))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("conv_id"), F.lit(HELD_OUT)) == 0, F.lit(False))


def fit(turns: DataFrame) -> Model:
    """Probabilities from labelled turns; every count is an aggregate of at most a few hundred rows."""
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce("role", F.lit(""))).cast("int") - 1
    known = turns.withColumn("_role", role).where(F.col("_role") >= 0)
    known = known.groupBy("conv_id", "turn").agg(F.min("_role").alias("_role"), F.min("text").alias("text"))
    known = known.withColumn("_n", F.size(F.split("text", "\n")))
    emit, step, start = np.zeros((len(STATES), CODES)), np.zeros((len(STATES), len(STATES))), np.zeros(len(STATES))
    split = known.select("_role", F.posexplode(F.split("text", "\n")).alias("_at", "line"))
    for r in split.groupBy("_role", (F.col("_at") > 0).alias("_on"), observed(F.col("line")).alias("code")).count().collect():
        emit[2 * r["_role"] + r["_on"], r["code"]] += r["count"]
    follow = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("_role").alias("_next"))
    pairs = known.join(follow, ["conv_id", "turn"], "left")
    ahead = pairs.groupBy("_role", (F.col("_n") > 1).alias("_on"), "_next").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_n") - 1).alias("goes")).collect()
    for r in ahead:
        if r["_next"] is not None:
            step[2 * r["_role"] + r["_on"], 2 * r["_next"]] += r["n"]
        if r["_on"]:
            step[2 * r["_role"], 2 * r["_role"] + 1] += r["n"]
            step[2 * r["_role"] + 1, 2 * r["_role"] + 1] += r["goes"] - r["n"]
    for r in known.where(F.col("turn") == 0).groupBy("_role").count().collect():
        start[2 * r["_role"]] += r["count"]
    return Model(start, step, emit)


def plain_ids(rows: pd.DataFrame) -> pd.DataFrame:
    """The ids as plain objects: text, or None."""
    return rows.assign(conv_id=pd.Series([None if pd.isna(c) else str(c) for c in rows["conv_id"]], index=rows.index, dtype=object))


def parse(turns: DataFrame, model: Model) -> DataFrame:
    """Canonical turns of raw transcripts (conv_id, turn, text): conv_id, turn, role, n_lines, rendered."""
    named = turns.withColumn("conv_id", id_text("conv_id"))
    rows = materialise(lines(named).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS)), "chat-lines")
    buckets = 2 * max(partitions(turns.sparkSession), rows.count() // LINES_PER_BUCKET)  # so that a bucket's size is the same at any input
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id", "block"), F.lit(buckets)).cast("int"))
    order, key = ["conv_id", "block", "turn", "_nth", "_at"], ["conv_id", "block"]

    def blocks(part: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        part = part.sort_values(order, na_position="first", kind="stable")
        return iter(part.groupby(key, dropna=False, sort=False))

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        out = [(c, b, model.weights(g["code"].to_numpy()).reshape(-1).tolist()) for (c, b), g in blocks(part)]
        return plain_ids(pd.DataFrame(out, columns=["conv_id", "block", "weights"]))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, g in part.groupby("conv_id", dropna=False):
            g = g.sort_values("block")
            score, came, n = model.start, [], len(STATES)
            for i, w in enumerate(g["weights"]):
                w = np.asarray(w).reshape(n, n)
                if i:
                    reach = score[:, None] + w
                    came.append(reach.argmax(axis=0))
                    score = reach.max(axis=0)
                else:
                    score = np.asarray(g["first"].iloc[0])
            last = [int(score.argmax())]
            for c in reversed(came):
                last.append(int(c[last[-1]]))
            last.reverse()
            out += [(conv, b, None if i == 0 else last[i - 1], x) for i, (b, x) in enumerate(zip(g["block"], last, strict=True))]
        out = plain_ids(pd.DataFrame(out, columns=["conv_id", "block", "before", "last"]))
        for c in ("before", "last"):
            out[c] = pd.array(out[c], dtype="Int64")
        return out

    def first(part: pd.DataFrame) -> pd.DataFrame:
        out = reduce(part)
        starts = []
        for _, g in blocks(part):
            codes, score = g["code"].to_numpy(), None
            for code in codes:
                score = (model.start if score is None else (score[:, None] + model.step).max(axis=0)) + model.emit[code]
            starts.append(score.tolist())
        out["first"] = starts
        return out

    weights = rows.groupBy("bucket").applyInPandas(first, "conv_id string, block long, weights array<double>, first array<double>")
    conv_bucket = F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int")
    fixed = weights.withColumn("bucket", conv_bucket).groupBy("bucket").applyInPandas(chain, "conv_id string, block long, before int, last int")
    fixed = fixed.withColumn("bucket", F.pmod(F.xxhash64("conv_id", "block"), F.lit(buckets)).cast("int"))

    def label(part: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        known = {(None if pd.isna(c) else c, b): (x, y) for c, b, x, y in zip(ends["conv_id"], ends["block"], ends["before"], ends["last"], strict=True)}
        out = []
        for (c, b), g in blocks(part):
            before, last = known[None if pd.isna(c) else c, b]
            path = model.trace(g["code"].to_numpy(), None if pd.isna(before) else int(before), int(last))
            opens = np.array([STATES[s][1] for s in path])
            out.append(g.assign(role=[ROLES[STATES[s][0]] for s in path], own=np.cumsum(opens), line_no=np.arange(len(g))))
        return plain_ids(pd.concat(out)[["conv_id", "block", "own", "line_no", "role", "line"]])

    labelled = rows.groupBy("bucket").cogroup(fixed.groupBy("bucket")).applyInPandas(label, "conv_id string, block long, own long, line_no long, role string, line string")
    labelled = materialise(labelled, "chat-labels")
    opened = labelled.groupBy("conv_id", "block").agg(F.max("own").alias("_opened"))
    before = F.sum("_opened").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offset = opened.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = labelled.join(offset, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    numbered = numbered.withColumn("turn", F.col("_offset") + F.col("own") - 1)
    head = F.min(F.struct("block", "line_no", "role"))["role"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = numbered.groupBy("conv_id", "turn").agg(head.alias("role"), F.count(F.lit(1)).alias("n_lines"), text.alias("_text"))
    speaker = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, ROLES[v])])
    marked = F.element_at(speaker, F.lower(F.regexp_extract("_text", MARKER, 1))) == F.col("role")  # else the head is text
    plain = F.when(marked, F.regexp_replace("_text", MARKER, "")).otherwise(F.col("_text"))
    return grouped.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "n_lines", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), plain, F.lit("\n<|end|>")).alias("rendered"))


def op1_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcripts(table(spark, sf_dir, "conversations"))
    return parse(turns, fit(turns.where(~held_out())))
