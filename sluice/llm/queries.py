"""The registered queries of the corpus operators."""

from __future__ import annotations

from sluice.llm import ann, hard_negatives, html_text, importance, lm_score, mixing, near_dedup, ngram_join, packing, quality, secrets, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": near_dedup.query,
        "op2_best_fit_packing": packing.query,
        "op3_lm_scoring": lm_score.query,
        "op4_url_filters": url_filter.query,
        "op5_mixing": mixing.query,
        "op6_nearest_neighbours": ann.query,
        "op7_html_extraction": html_text.query,
        "op8_ngram_jaccard_join": ngram_join.query,
        "op9_secret_scans": secrets.query,
        "op10_quality_classifier": quality.query,
        "op11_importance_resampling": importance.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_token_counts": token_counts.query,
    }


def oracle_sql() -> dict:
    return {"op4_url_filters": url_filter.sql(), "op5_mixing": mixing.sql(), "op11_importance_resampling": importance.sql(), "op12_hard_negatives": hard_negatives.sql()}
