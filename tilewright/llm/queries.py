"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tilewright.llm import alignment, byte_bpe, hard_negatives, language_id, mixing, mpeg_audio, multiset_hash, sharding, simhash, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_toxicity": toxicity.query,
    "op4_token_counts": token_counts.query,
    "op5_multiset_fingerprints": multiset_hash.query,
    "op6_mix_sources": mixing.query,
    "op7_language_id": language_id.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_mpeg_audio": mpeg_audio.query,
    "op10_shuffle_shards": sharding.query,
    "op11_token_files": token_files.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_token_alignment": alignment.query,
}
SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op6_mix_sources": mixing.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
