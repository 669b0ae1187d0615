"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, html_extract, neardup, packing, pii, quality, tiff, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.query,
    "op2_bpe": bpe.query,
    "op3_url_filter": url_filter.query,
    "op4_tiff": tiff.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_near_duplicates": neardup.query,
    "op8_chat": chat.query,
    "op9_html": html_extract.query,
    "op10_pii": pii.query,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op3_url_filter": url_filter.oracle_sql()}
