"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from reviewlens.llm import (
    op1_toxicity, op2_minhash, op3_language, op4_sharding, op5_pieces, op6_fingerprints, op7_binary, op8_quality, op9_counts, op10_packing,
    op11_search, op12_bytes, op13_whitening,
)

QUERIES = {
    "op1_toxicity": op1_toxicity.query,
    "op2_near_duplicates": op2_minhash.query,
    "op3_language_id": op3_language.query,
    "op4_hilbert_shards": op4_sharding.query,
    "op5_pieces": op5_pieces.query,
    "op6_fingerprints": op6_fingerprints.query,
    "op7_token_files": op7_binary.query,
    "op8_quality_rules": op8_quality.query,
    "op9_token_counts": op9_counts.query,
    "op10_best_fit_packing": op10_packing.query,
    "op11_ranked_search": op11_search.query,
    "op12_byte_bpe": op12_bytes.query,
    "op13_whitening": op13_whitening.query,
}
CHECK_SQL = {
    "op2_near_duplicates": op2_minhash.check_sql(),
    "op8_quality_rules": op8_quality.check_sql(),
    "op11_ranked_search": op11_search.check_sql(),
}
