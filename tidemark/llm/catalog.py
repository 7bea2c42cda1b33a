"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import jaccard, langid, licenses, manifest, media, negatives, ngram, packing, pieces, quality, sharding, simhash, substrings

MODULES = (packing, pieces, quality, licenses, sharding, langid, ngram, substrings, media, jaccard, manifest, negatives, simhash)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
