"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datastrata.llm import (
    decontaminate,
    edit_fingerprint,
    filter_audit,
    html_extract,
    jaccard_join,
    mixing,
    quality,
    secrets,
    substring_dedup,
    suffix_tree,
    token_alignment,
    token_counts,
    token_output,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_token_output": token_output.op7_token_output,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_lm_score": suffix_tree.op9_lm_score,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_edit_fingerprint": edit_fingerprint.op12_edit_fingerprint,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
