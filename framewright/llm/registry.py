"""Queries and SQL of all operators of this subpackage."""

from __future__ import annotations

from . import classifier, lines, mixing, near, packing, quality, sharding, substrings, topk, urls

MODULES = (mixing, near, packing, quality, classifier, substrings, urls, sharding, topk, lines)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE", {}).items()}
