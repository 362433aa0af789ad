"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import chat, divergence, jaccard, katz, licences, line_dedup, packing, pieces, quality, repair, sharding, topk, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_licence_scans": licences.op2_licence_scans,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_piece_encoding": pieces.op4_piece_encoding,
    "op5_minimax_sharding": sharding.op5_minimax_sharding,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_katz_scoring": katz.op9_katz_scoring,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE = {
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op10_exact_topk": topk.OP10_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
