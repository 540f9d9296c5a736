"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    op01_jaccard_join,
    op02_packing,
    op03_vector_index,
    op04_paragraphs,
    op05_html_text,
    op06_preferences,
    op07_exact_substrings,
    op08_license_scan,
    op09_decontaminate,
    op10_toxicity,
)

QUERIES = {
    "op1_ngram_jaccard_join": op01_jaccard_join.op1_ngram_jaccard_join,
    "op2_packing": op02_packing.op2_packing,
    "op3_vector_dedup": op03_vector_index.op3_vector_dedup,
    "op4_paragraph_dedup": op04_paragraphs.op4_paragraph_dedup,
    "op5_html_text": op05_html_text.op5_html_text,
    "op6_preferences": op06_preferences.op6_preferences,
    "op7_exact_substrings": op07_exact_substrings.op7_exact_substrings,
    "op8_license_scan": op08_license_scan.op8_license_scan,
    "op9_decontamination": op09_decontaminate.op9_decontamination,
    "op10_toxicity": op10_toxicity.op10_toxicity,
}

SQL = {"op6_preferences": op06_preferences.SQL, "op8_license_scan": op08_license_scan.SQL}
