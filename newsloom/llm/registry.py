"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from newsloom.llm import byte_bpe, cap_filters, exact_dedup, hard_negatives, html_extract, language_id, license_scan, minhash, mixing, periodic_runs, pii, quality, substring_dedup

MODULES = [exact_dedup, byte_bpe, license_scan, language_id, html_extract, quality, mixing, minhash, cap_filters, substring_dedup, hard_negatives, periodic_runs, pii]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
