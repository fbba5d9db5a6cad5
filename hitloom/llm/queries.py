"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from hitloom.llm import bpe, convtrie, exact_dedup, hardneg, hostrules, html_extract, langid, mixing, neardup, ordinal, suffix_dedup, tokencount, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": hostrules.op6_quality_rules,
    "op7_quality_grade": ordinal.op7_quality_grade,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_conversation_trie": convtrie.op13_conversation_trie,
}
ORACLE_SQL = {
    "op2_near_duplicates": neardup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_quality_rules": hostrules.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_conversation_trie": convtrie.ORACLE,
}
