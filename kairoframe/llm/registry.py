"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, langid, near_dedup, packing, secret_scan, sharding, suffix_dedup, topk_search, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_bpe": bpe.op3_bpe,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_topk_search": topk_search.op8_topk_search,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

ORACLES = {
    "op5_sharding": sharding.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op8_topk_search": topk_search.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
}
