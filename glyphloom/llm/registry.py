"""Queries and SQL of the corpus operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat, language, media, mixing, packing, quality, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_telephony_audio": media.op4_telephony_audio,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_url_filters": urls.op10_url_filters,
}
SQL = {
    "op3_chat_formatting": chat.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_url_filters": urls.SQL,
}
