"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bm25, html_text, jaccard_join, merkle, near_vectors, packing, pieces, substring_dedup, token_counts, toxicity, url_filter, warc, whitening


def queries() -> dict:
    return {
        "op1_html": html_text.op1_html,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_embeddings": near_vectors.op4_embeddings,
        "op5_packing": packing.op5_packing,
        "op6_jaccard": jaccard_join.op6_jaccard,
        "op7_warc": warc.op7_warc,
        "op8_bm25": bm25.op8_bm25,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_whitening": whitening.op11_whitening,
        "op12_merkle": merkle.op12_merkle,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embeddings": near_vectors.ORACLE,
        "op2_url_filter": url_filter.ORACLE,
        "op6_jaccard": jaccard_join.ORACLE,
        "op7_warc": warc.ORACLE,
        "op12_merkle": merkle.ORACLE,
    }
