"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from framewright.llm import op1_fingerprint, op2_suffix, op3_language, op4_mixing, op5_quality, op6_bpe, op7_license, op8_embeddings, op9_minhash, op10_substring

QUERIES = {
    "op1_fingerprint": op1_fingerprint.query,
    "op2_suffix_dedup": op2_suffix.query,
    "op3_language": op3_language.query,
    "op4_mixing": op4_mixing.query,
    "op5_quality": op5_quality.query,
    "op6_bpe": op6_bpe.query,
    "op7_license": op7_license.query,
    "op8_embeddings": op8_embeddings.query,
    "op9_minhash": op9_minhash.query,
    "op10_substring_dedup": op10_substring.query,
}
SQL = {
    "op4_mixing": op4_mixing.SQL,
    "op7_license": op7_license.SQL,
    "op8_embeddings": op8_embeddings.SQL,
    "op9_minhash": op9_minhash.SQL,
}
