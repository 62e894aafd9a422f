"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embeddings, language, packing, page_text, phrases, pieces, quality_model, rules, secrets, simhash, spelling, substrings, warc

MODULES = (simhash, packing, pieces, embeddings, substrings, rules, warc, quality_model, secrets, language, spelling, phrases, page_text)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
