"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module with query() and, where SQL can express it, ORACLE
MODULES = {
    "op1_brown_scoring": "brown",
    "op2_ngram_jaccard": "jaccard",
    "op3_token_counts": "token_counts",
    "op4_avi_media": "media",
    "op5_secret_scans": "secrets",
    "op6_byte_bpe": "bpe",
    "op7_language_id": "langid",
    "op8_multi_index": "multi_index",
    "op9_source_mixing": "mixing",
    "op10_suffix_dedup": "repeats",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
