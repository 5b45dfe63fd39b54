"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from graphsearch.llm import decontaminate, license_scan, merges, minhash, permutation_index, quotes, resample, substring, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_license_scan": license_scan.query,
    "op3_toxicity": toxicity.query,
    "op4_quotes": quotes.query,
    "op5_sentencepiece": merges.query,
    "op6_resample": resample.query,
    "op7_permutation_index": permutation_index.query,
    "op8_minhash_dedup": minhash.query,
    "op9_substring_dedup": substring.query,
    "op10_url_filter": url_filter.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op8_minhash_dedup": minhash.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
