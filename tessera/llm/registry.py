"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ctw, jpeg, langid, mixing, packing, quality, records, sharding, simhash, urlfilter

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": langid.op3_language_id,
    "op4_lm_scoring": ctw.op4_lm_scoring,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_binary_records": records.op8_binary_records,
    "op9_media_jpeg": jpeg.op9_media_jpeg,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op6_url_filter": urlfilter.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
