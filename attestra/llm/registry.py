"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, licenses, mixing, ngram_join, pii, quality, token_counts, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_url_filters": url_filter.op6_url_filters,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_license_scans": licenses.op9_license_scans,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.SQL,
        "op2_decontamination": decontam.SQL,
        "op3_mixing": mixing.SQL,
        "op6_url_filters": url_filter.SQL,
        "op7_ngram_join": ngram_join.SQL,
        "op9_license_scans": licenses.SQL,
    }
