"""The queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import alignment, decontamination, exact_dedup, language_id, line_dedup, packing, quality, resampling, secret_scan, sharding, simhash_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_language_id": language_id.op8_language_id,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op6_url_filter": url_filter.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_secret_scan": secret_scan.ORACLE,
}
