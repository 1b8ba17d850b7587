"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from vectrill.llm import decontam, exact_dedup, language, license, mixing, near_dedup, pii, token_counts, token_store, toxicity

QUERIES = {
    "op1_language_id": language.query,
    "op2_token_counts": token_counts.query,
    "op3_license_scan": license.query,
    "op4_near_dedup": near_dedup.query,
    "op5_token_store": token_store.query,
    "op6_mixing": mixing.query,
    "op7_pii": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_decontaminate": decontam.query,
}
SQL = {
    "op3_license_scan": license.SQL,
    "op4_near_dedup": near_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_decontaminate": decontam.SQL,
}
