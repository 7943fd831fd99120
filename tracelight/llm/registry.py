"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm import chat, decontaminate, embeddings, html, langid, licenses, mixing, quality, simhash, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_url_filters": urls.op5_url_filters,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
}

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": embeddings.OP2_SQL,
    "op5_url_filters": urls.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
