"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, html, jaccard, mixing, quality, substrings, tokens, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_mix_sources": mixing.op2,
    "op3_html_text": html.op3,
    "op4_quality": quality.op4,
    "op5_similar_texts": jaccard.op5,
    "op6_chat_format": chat.op6,
    "op7_warc": warc.op7,
    "op8_token_counts": tokens.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_repeated_substrings": substrings.op10,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op3_html_text": html.ORACLE_SQL,
    "op5_similar_texts": jaccard.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_repeated_substrings": substrings.ORACLE_SQL,
}
