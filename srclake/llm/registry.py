"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, decontaminate, hmm_lm, language_id, license_scan, line_dedup, near_dedup, ngram_quality, packing, prefix_trie, quality, topk, vector_codes


def queries() -> dict[str, Callable]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_quality": quality.op4_quality,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_topk_search": topk.op7_topk_search,
        "op8_packing": packing.op8_packing,
        "op9_chat_format": chat.op9_chat_format,
        "op10_hmm_lm": hmm_lm.op10_hmm_lm,
        "op11_quality_rules": ngram_quality.op11_quality_rules,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_near_dedup": near_dedup.OP3_SQL,
        "op5_license_scan": license_scan.OP5_SQL,
        "op7_topk_search": topk.OP7_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
