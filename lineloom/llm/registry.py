"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm import collocations, conversation_repair, decontaminate, html_text, language_id, license_scan, metric_search, packing, pii, simhash, substring_dedup, token_count, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_language_id": language_id.op4_language_id,
    "op5_html_text": html_text.op5_html_text,
    "op6_packing": packing.op6_packing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_simhash": simhash.op9_simhash,
    "op10_topk": metric_search.op10_topk,
    "op11_collocations": collocations.op11_collocations,
    "op12_token_count": token_count.op12_token_count,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_topk": metric_search.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
