"""The queries of this subpackage: op<N>_<name> over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, language_id, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, resampling, source_divergence, suffix_dedup, token_counts, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_token_counts": token_counts.query,
        "op3_url_filters": url_filters.query,
        "op4_language_id": language_id.query,
        "op5_quality_classifier": quality_classifier.query,
        "op6_mixing": mixing.query,
        "op7_decontamination": decontamination.query,
        "op8_suffix_dedup": suffix_dedup.query,
        "op9_quality_rules": quality_rules.query,
        "op10_minhash": minhash.query,
        "op11_source_divergence": source_divergence.query,
        "op12_best_fit_packing": packing.query,
        "op13_importance_resampling": resampling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op8_suffix_dedup": suffix_dedup.ORACLE,
        "op10_minhash": minhash.ORACLE,
        "op11_source_divergence": source_divergence.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
