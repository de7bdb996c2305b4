"""The corpus pipeline: five of the corpus operators in sequence.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.

A toxic document is rejected (stage 1); of each group of near duplicates (0.8 or more of their five-word shingles in
common) the one with the smallest id stays, of repeated rows any one (stage 2: SimHash proposes, and so do bands of
least hashes, since fingerprints alone are not enough, as the README says; an exact check decides); bytes that repeat a 50-byte string of an earlier document are cut, and
documents of which nothing is left go (stage 3); documents that overlap a benchmark item go (stage 4); the rest is
packed (stage 5). Stages work whatever further columns the documents have; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm._util import materialise, table
from lakeloom.llm.decontamination import decontaminate
from lakeloom.llm.packing import pack_documents
from lakeloom.llm.shingle_dedup import representatives
from lakeloom.llm.suffix_dedup import remove_repeats
from lakeloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Shingles, tokens and compression have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
