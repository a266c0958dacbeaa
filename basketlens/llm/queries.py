"""Queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from basketlens.llm import bpe, clustering, exact_dedup, language, licenses, line_dedup, ngram_join, packing, pages, quality, secrets, spelling, substring_dedup

REGISTRY = {
    "op7_ngram_join": ngram_join.query,
    "op3_substring_dedup": substring_dedup.query,
    "op9_line_dedup": line_dedup.query,
    "op4_license_scan": licenses.query,
    "op1_html_text": pages.query,
    "op5_language_id": language.query,
    "op2_best_fit_packing": packing.query,
    "op6_quality_rules": quality.query,
    "op8_byte_bpe": bpe.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_spelling_variants": spelling.query,
    "op12_secret_scan": secrets.query,
    "op13_centroid_clustering": clustering.query,
}

SQL = {
    "op3_substring_dedup": substring_dedup.SQL,
    "op6_quality_rules": quality.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_secret_scan": secrets.SQL,
    "op13_centroid_clustering": clustering.SQL,
}
