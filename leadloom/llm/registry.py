"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from leadloom.llm import chat_format, exact_dedup, filter_audit, html_extraction, language_id, lm_scoring, mixing, packing, quality_rules, simhash, spelling_variants, substring_dedup, token_store

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_packing": packing.op2_packing,
    "op3_token_store": token_store.op3_token_store,
    "op4_simhash": simhash.op4_simhash,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_lm_scoring": lm_scoring.op13_lm_scoring,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
