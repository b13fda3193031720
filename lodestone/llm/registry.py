"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from lodestone.llm import (
    byte_bpe,
    exact_dedup,
    language_id,
    licenses,
    packing,
    quality_rules,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_store,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_store": token_store.op2_token_store,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_simhash": simhash.op6_simhash,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op5_license_scans": licenses.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
