"""The operators' queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, packing, quality, simhash, substring, token_counts, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_warc": warc.query,
    "op3_token_files": token_files.query,
    "op4_toxicity": toxicity.query,
    "op5_packing": packing.query,
    "op6_url_filter": url_filter.query,
    "op7_substring": substring.query,
    "op8_quality": quality.query,
    "op9_token_counts": token_counts.query,
    "op10_simhash": simhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_substring": substring.ORACLE_SQL,
    "op8_quality": quality.ORACLE_SQL,
}
