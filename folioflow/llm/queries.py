"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, exact_search, hard_negatives, line_dedup, mixing, near_dedup, prefix_trie, quality_classifier, quality_rules, substring_dedup, token_store, warc

QUERIES = {
    "op1_chat_formatting": chat.op1_chats,
    "op2_quality_rules": quality_rules.op2_rules,
    "op3_mixing": mixing.op3_mix,
    "op4_substring_dedup": substring_dedup.op4_substrings,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontaminate.op6_leaks,
    "op7_quality_classifier": quality_classifier.op7_scores,
    "op8_near_dedup": near_dedup.op8_near,
    "op9_line_dedup": line_dedup.op9_lines,
    "op10_token_store": token_store.op10_tokens,
    "op11_prefix_trie": prefix_trie.op11_trie,
    "op12_hard_negatives": hard_negatives.op12_negatives,
    "op13_exact_search": exact_search.op13_nearest,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_exact_search": exact_search.OP13_SQL,
}
