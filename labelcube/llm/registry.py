"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import exact_dedup, html, media, mixing, packing, pitman_yor, quality, simhash, substring, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_simhash": simhash.query,
    "op3_html": html.query,
    "op4_mixing": mixing.query,
    "op5_media": media.query,
    "op6_toxicity": toxicity.query,
    "op7_packing": packing.query,
    "op8_substring": substring.query,
    "op9_quality": quality.query,
    "op10_pitman_yor": pitman_yor.query,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_mixing": mixing.sql(),
    "op8_substring": substring.SQL,
}
