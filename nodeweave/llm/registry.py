"""Queries of this subpackage, and DuckDB SQL where it can express them."""

from nodeweave.llm import byte_bpe, exact_dedup, near_dedup, packing, quality_model, quality_rules, secret_scan, substring_dedup, url_filter, warc_zip

QUERIES = {
    "op1_near_dedup": near_dedup.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_warc_zip": warc_zip.op5,
    "op6_byte_bpe": byte_bpe.op6,
    "op7_quality_model": quality_model.op7,
    "op8_url_filter": url_filter.op8,
    "op9_packing": packing.op9,
    "op10_quality_rules": quality_rules.op10,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE3,
    "op5_warc_zip": warc_zip.ORACLE5,
    "op8_url_filter": url_filter.ORACLE8,
    "op10_quality_rules": quality_rules.oracle10(),
}
