"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    kn_toxicity,
    language_id,
    license_scan,
    phrase_mining,
    pivot_topk,
    secret_linking,
    sentencepiece_codec,
    simhash_vptree,
    source_mixing,
    spelling_variants,
    spotsigs,
    substring_dedup,
    tiered_shards,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_pivot_topk": pivot_topk.op2_pivot_topk,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": kn_toxicity.op4_toxicity,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_simhash_near_dedup": simhash_vptree.op6_simhash_near_dedup,
    "op7_source_mixing": source_mixing.op7_source_mixing,
    "op8_tiered_shards": tiered_shards.op8_tiered_shards,
    "op9_spotsigs": spotsigs.op9_spotsigs,
    "op10_secret_linking": secret_linking.op10_secret_linking,
    "op11_phrase_mining": phrase_mining.op11_phrase_mining,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_pivot_topk": pivot_topk.ORACLE,
    "op10_secret_linking": secret_linking.ORACLE,
    "op11_phrase_mining": phrase_mining.ORACLE,
    "op12_substring_dedup": substring_dedup.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}
