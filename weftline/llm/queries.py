"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm import collocations, decontaminate, exact_dedup, line_dedup, pii, quality, schema_rewrite, secret_scan, sentencepiece_lattice, sharding, simhash, token_counts, token_output

QUERIES = {
    "op1_token_attribution": token_counts.query,
    "op2_sentencepiece_lattice": sentencepiece_lattice.query,
    "op3_stratified_shards": sharding.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_fuzzy_line_dedup": line_dedup.query,
    "op6_orc_token_ids": token_output.query,
    "op7_benchmark_windows": decontaminate.query,
    "op8_pii_spans": pii.query,
    "op9_factorisation_machine": quality.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_phrase_collocations": collocations.query,
    "op12_secret_ownership": secret_scan.query,
    "op13_drifted_rewrite": schema_rewrite.query,
}

ORACLES = {
    "op3_stratified_shards": sharding.ORACLE,
    "op7_benchmark_windows": decontaminate.ORACLE,
    "op8_pii_spans": pii.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op12_secret_ownership": secret_scan.ORACLE,
}
