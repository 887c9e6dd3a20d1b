"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import dual_tree_search, hmm_scoring, html_extraction, lz_fingerprint, nbest_pieces, near_dedup, ordinal_quality, packing, pii, quality_rules, secrets, spelling_variants, url_filter


def queries() -> dict:
    return {
        "op1_ordinal_quality": ordinal_quality.op1_ordinal_quality,
        "op2_power_of_two_packing": packing.op2_power_of_two_packing,
        "op3_weak_supervision_pii": pii.op3_weak_supervision_pii,
        "op4_lz_fingerprint": lz_fingerprint.op4_lz_fingerprint,
        "op5_boosted_url_filter": url_filter.op5_boosted_url_filter,
        "op6_guess_cost_secrets": secrets.op6_guess_cost_secrets,
        "op7_setsketch_near_dedup": near_dedup.op7_setsketch_near_dedup,
        "op8_nbest_pieces": nbest_pieces.op8_nbest_pieces,
        "op9_hmm_scores": hmm_scoring.op9_hmm_scores,
        "op10_learned_rules": quality_rules.op10_learned_rules,
        "op11_dual_tree_search": dual_tree_search.op11_dual_tree_search,
        "op12_scored_article_text": html_extraction.op12_scored_article_text,
        "op13_permuterm_variants": spelling_variants.op13_permuterm_variants,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for what does not learn, tokenize or hash beyond plain SQL."""
    return {"op11_dual_tree_search": dual_tree_search.ORACLE_SQL}
