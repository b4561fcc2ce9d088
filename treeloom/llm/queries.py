"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from treeloom.llm import exact_dedup, language_id, license_scan, mixing, packing, quality_rules, secret_scan, simhash, token_files, warc_zst

QUERIES = {
    "op1_secret_ownership": secret_scan.op1_secret_ownership,
    "op2_host_quality": quality_rules.op2_host_quality,
    "op3_simhash_pivots": simhash.op3_simhash_pivots,
    "op4_license_join": license_scan.op4_license_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_token_arrow": token_files.op7_token_arrow,
    "op8_language_id": language_id.op8_language_id,
    "op9_warc_dictionary": warc_zst.op9_warc_dictionary,
    "op10_vector_packing": packing.op10_vector_packing,
}
ORACLES = {
    "op1_secret_ownership": secret_scan.scan_sql(),
    "op4_license_join": license_scan.scan_sql(),
    "op2_host_quality": quality_rules.verdicts_sql(),
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
}
