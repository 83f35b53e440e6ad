"""The registered queries of this folder, and their SQL where there is any."""

from __future__ import annotations

from . import ann, bpe, conversation_trie, exact_dedup, html_text, language_id, license_scan, line_dedup, mixing, ngram_join, sharding, spelling, substring_dedup

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_nearest": ann.op3_nearest,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_html_text": html_text.op9_html_text,
    "op10_language_id": language_id.op10_language_id,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_sharding": sharding.op12_sharding,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

ORACLE_SQL = {
    "op5_license_scan": license_scan.OP5_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
