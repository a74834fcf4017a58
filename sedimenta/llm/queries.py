"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, decontamination, html, language_id, line_dedup, packing, pii, quality, simhash, substring_dedup

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality": quality.op6_quality,
    "op7_html": html.op7_html,
    "op8_neighbours": ann.op8_neighbours,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_packing": packing.op10_packing,
}
SQL = {**line_dedup.SQL}
