"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from llm import binary_ids, bpe, bpe_automaton, chat, collocations, decontaminate, hamming, language, lexical_search, near_dedup, quality, rollup, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_bagminhash": near_dedup.op3_bagminhash,
    "op4_chat_format": chat.op4_chat_format,
    "op5_bpe": bpe.op5_bpe,
    "op6_language": language.op6_language,
    "op7_hamming_topk": hamming.op7_hamming_topk,
    "op8_binary_ids": binary_ids.op8_binary_ids,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_rollup": rollup.op10_token_rollup,
    "op11_collocations": collocations.op11_collocations,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_bpe_automaton": bpe_automaton.op13_bpe_automaton,
}
SQL = {
    "op4_chat_format": chat.OP4_SQL,
    "op7_hamming_topk": hamming.OP7_SQL,
    "op10_token_rollup": rollup.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
