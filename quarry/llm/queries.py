"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import decontaminate, html_text, language_id, line_dedup, mixing, ngram_join, quality_rules, secret_scan, token_counts, unit_dedup

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_mixing_sources": mixing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_token_counts": token_counts.query,
    "op7_html_extraction": html_text.query,
    "op8_secret_scans": secret_scan.query,
    "op9_quality_rules": quality_rules.query,
    "op10_substring_dedup": unit_dedup.query,
}
ORACLE_SQL: dict[str, str] = {"op3_mixing_sources": mixing.ORACLE_SQL}
