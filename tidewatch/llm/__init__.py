"""Operators on large collections of records, vectors and texts.  Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ["records", "baskets", "mixture", "vectors", "clusters", "leaks", "truncation"]


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"{__name__}.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
