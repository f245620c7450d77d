"""Queries of this subpackage, by name, and their DuckDB counterparts."""

from __future__ import annotations

from spanloom.llm import decontamination, fingerprints, html, infilling, jaccard, media, mixing, quality, resampling, secrets, sharding, substrings, warc


def queries() -> dict:
    return {
        "op1_html": html.op1_html,
        "op2_substrings": substrings.op2_substrings,
        "op3_warc": warc.op3_warc,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_sharding": sharding.op5_sharding,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_mixing": mixing.op7_mixing,
        "op8_secrets": secrets.op8_secrets,
        "op9_quality": quality.op9_quality,
        "op10_media": media.op10_media,
        "op11_resampling": resampling.op11_resampling,
        "op12_infilling": infilling.op12_infilling,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substrings": substrings.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op6_jaccard": jaccard.OP6_SQL,
        "op11_resampling": resampling.OP11_SQL,
        "op12_infilling": infilling.OP12_SQL,
    }
