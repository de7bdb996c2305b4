"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakeloom.llm.chat_format import op1_chat_hmm
from lakeloom.llm.decontamination import op2_benchmark_decontamination
from lakeloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from lakeloom.llm.html_extraction import op3_html_template_extraction
from lakeloom.llm.minhash import op12_minhash_near_dedup
from lakeloom.llm.packing import op10_best_fit_packing
from lakeloom.llm.sharding import op4_histogram_sharding
from lakeloom.llm.simhash import op9_simhash_near_dedup
from lakeloom.llm.spelling import op13_spelling_variants
from lakeloom.llm.suffix_dedup import op8_suffix_array_dedup
from lakeloom.llm.token_counts import op5_token_counts
from lakeloom.llm.topk import OP7_SQL, op7_maxscore_top_k
from lakeloom.llm.toxicity import op6_zstd_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_hmm": op1_chat_hmm,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_html_template_extraction": op3_html_template_extraction,
        "op4_histogram_sharding": op4_histogram_sharding,
        "op5_token_counts": op5_token_counts,
        "op6_zstd_toxicity": op6_zstd_toxicity,
        "op7_maxscore_top_k": op7_maxscore_top_k,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_filter_audit": op11_filter_audit,
        "op12_minhash_near_dedup": op12_minhash_near_dedup,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_maxscore_top_k": OP7_SQL, "op11_filter_audit": OP11_SQL}
