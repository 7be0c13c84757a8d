"""The queries of the training-data operators."""

from __future__ import annotations

from chronofold.llm import chat_format, decontamination, html_text, language_id, line_dedup, matroska, ngram_join, packing, token_counts, toxicity

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_language_id": language_id.op5_language_id,
    "op6_matroska": matroska.op6_matroska,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLES: dict[str, str] = {"op4_chat_format": chat_format.ORACLE, "op8_ngram_join": ngram_join.ORACLE, "op10_decontamination": decontamination.ORACLE}
