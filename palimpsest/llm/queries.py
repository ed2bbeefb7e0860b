"""Queries of this subpackage by name, and the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from . import decontaminate, host_reputation, ngram_jaccard, permutation_index, quality_crf, secret_forest, sentencepiece_tokens, substring_dedup, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_permutation_index": permutation_index.op1_permutation_index,
        "op2_winnowing": decontaminate.op2_winnowing,
        "op3_kneser_ney": toxicity.op3_kneser_ney,
        "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
        "op5_repair_tokens": token_files.op5_repair_tokens,
        "op6_line_crf": quality_crf.op6_line_crf,
        "op7_host_reputation": host_reputation.op7_host_reputation,
        "op8_fixed_blocks": substring_dedup.op8_fixed_blocks,
        "op9_sentencepiece": sentencepiece_tokens.op9_sentencepiece,
        "op10_secret_forest": secret_forest.op10_secret_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_winnowing": decontaminate.SQL, "op4_ngram_jaccard": ngram_jaccard.SQL, "op7_host_reputation": host_reputation.SQL, "op8_fixed_blocks": substring_dedup.SQL}
