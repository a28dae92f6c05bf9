"""The queries of this subpackage and, where SQL expresses one, its DuckDB statement."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_warc_index": warc.op4_warc_index,
    "op5_language_id": language_id.op5_language_id,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_poisson_mixing": mixing.op7_poisson_mixing,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan.OP1_SQL, "op7_poisson_mixing": mixing.OP7_SQL}
