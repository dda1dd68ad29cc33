"""Named queries over the project's tables; each module gives QUERIES and, where SQL can say it, SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["addresses", "primitives", "commands", "sessions", "ips", "vectors", "campaigns", "lifecycle", "findings", "intel", "serving", "evaluation", "entities", "upkeep", "streams", "rollups", "features", "assignment", "tracking", "views"]


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"{__name__}.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
