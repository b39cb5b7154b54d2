"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, extraction, language, media, middle, near_duplicates, negatives, pieces, secrets, sharding, substrings, suffixes, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_suffix_dedup": suffixes.op2_suffix_dedup,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_near_dedup": near_duplicates.op4_near_dedup,
        "op5_url_filters": urls.op5_url_filters,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_language_id": language.op7_language_id,
        "op8_media_columns": media.op8_media_columns,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_fill_in_middle": middle.op11_fill_in_middle,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_html_extraction": extraction.op13_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.ORACLE, "op3_decontamination": decontamination.ORACLE, "op5_url_filters": urls.oracle(), "op11_fill_in_middle": middle.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_html_extraction": extraction.ORACLE}
