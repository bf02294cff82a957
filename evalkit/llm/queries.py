"""The subpackage's queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, jaccard_join, lm_scores, pii, quality, sentencepiece_codec, sharding, substring_dedup, token_counts

_MODULES = (
    ("op1_substring_dedup", substring_dedup),
    ("op2_exact_dedup", exact_dedup),
    ("op3_quality", quality),
    ("op4_pii", pii),
    ("op5_sentencepiece", sentencepiece_codec),
    ("op6_lm_scores", lm_scores),
    ("op7_token_counts", token_counts),
    ("op8_decontaminate", decontaminate),
    ("op9_jaccard_join", jaccard_join),
    ("op10_sharding", sharding),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES if module.SQL}
