"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewire.llm import bpe, chat, embedding, lines, packing, simhash, sketch, substrings, toxicity, warc

QUERIES = {
    "op1_embedding_dedup": embedding.query,
    "op2_simhash_dedup": simhash.query,
    "op3_best_fit_packing": packing.query,
    "op4_chat_format": chat.query,
    "op5_sketch": sketch.query,
    "op6_bpe": bpe.query,
    "op7_line_dedup": lines.query,
    "op7_line_dedup_whole": lines.whole_query,
    "op8_warc_audit": warc.query,
    "op9_suffix_dedup": substrings.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding.SQL,
    "op4_chat_format": chat.SQL,
    "op7_line_dedup": lines.SQL,
    "op7_line_dedup_whole": lines.WHOLE_SQL,
    "op8_warc_audit": warc.SQL,
}
