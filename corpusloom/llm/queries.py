"""The queries of this package for the driver's registry, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, embedding_dedup, filter_audit, language_id, minhash, mixing, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_chat_format": chat.op11_chat_format,
    "op12_whitening": whitening.op12_whitening,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_minhash": minhash.OP4_SQL,
    "op8_embedding_dedup": embedding_dedup.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_chat_format": chat.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
