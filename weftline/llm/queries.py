"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, bpe_codec, jaccard_join, language_id, quality_rules, secret_scan, source_mixing, token_counts, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secret_scan.op1_secret_scans,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_bpe_codec": bpe_codec.op6_bpe_codec,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_source_mixing": source_mixing.op9_source_mixing,
        "op10_ann_search": ann_search.op10_ann_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": secret_scan.oracle(), "op2_jaccard_join": jaccard_join.SQL, "op8_url_filters": url_filters.oracle(), "op9_source_mixing": source_mixing.oracle([f"src{i}" for i in range(20)])}
