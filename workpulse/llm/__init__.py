"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    """The queries opN_<name> by name."""
    from . import ann, decontam, htmltext, interaction, langid, licenses, lm, mixing, neardup, packing, ranked, secrets, toxicity

    found = (
        licenses.op1_license_scan, lm.op2_lm_scoring, decontam.op3_decontamination, langid.op4_language_id, toxicity.op5_toxicity, ann.op6_multi_index_hashing, htmltext.op7_html_extraction, packing.op8_best_fit_packing,
        secrets.op9_secret_scan, neardup.op10_minhash_near_dedup, interaction.op11_filter_interaction, mixing.op12_source_mix, ranked.op13_ranked_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    from . import interaction, licenses, mixing, ranked

    return {"op1_license_scan": licenses.sql(), "op11_filter_interaction": interaction.sql(), "op12_source_mix": mixing.sql(), "op13_ranked_search": ranked.sql()}
