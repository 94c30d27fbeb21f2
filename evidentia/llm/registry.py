"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_extraction, licence_scan, near_dedup, packing, secret_scan, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_decontamination": decontamination.op2_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_licence_scan": licence_scan.op8_licence_scan,
}
SQL = {"op7_exact_dedup": exact_dedup.SQL}
