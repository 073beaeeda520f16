"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from roadpulse.llm import (
    exact_dedup, fingerprints, langid, licenses, mixing, near_dedup, personal_data, pieces, quality, ranking, toxicity,
    url_filter, whitening,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sentence_pieces": pieces.op4_sentence_pieces,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_cross_parsing": langid.op6_cross_parsing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_importance_resampling": quality.op9_importance_resampling,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_whitening": whitening.op11_whitening,
    "op12_personal_data": personal_data.op12_personal_data,
    "op13_ranked_search": ranking.op13_ranked_search,
}
ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_url_filters": url_filter.SQL,
    "op13_ranked_search": ranking.SQL,
}
