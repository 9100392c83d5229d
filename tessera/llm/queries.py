"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_benchmark_decontamination": "decontaminate",
    "op2_language_id": "language",
    "op3_url_filters": "urls",
    "op4_ngram_jaccard_join": "jaccard",
    "op5_quality_classifier": "quality",
    "op6_flac_media": "flac",
    "op7_substring_dedup": "phrases",
    "op8_hmm_lm_scoring": "hmm",
    "op10_suffix_array_dedup": "suffixes",
    "op9_byte_bpe": "bpe",
}


def queries() -> dict:
    return {name: importlib.import_module(f"tessera.llm.{module}").query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import urls

    return {"op3_url_filters": urls.SQL}
