"""Registry of the queries of this subpackage and of their SQL."""

from __future__ import annotations

from . import cover_tree, mixing, packing, pii, quality, secret_scan, simhash, suffix_dedup, toxicity, warc

MODULES = (warc, packing, secret_scan, cover_tree, mixing, toxicity, simhash, quality, pii, suffix_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
