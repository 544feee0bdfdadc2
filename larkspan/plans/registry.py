"""All queries of the core, by name."""

from __future__ import annotations

import importlib

MODULES = ("heavy", "scans", "lexical", "vectors", "fusion", "leakage", "keyed_lexical", "stores")


def collected() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"larkspan.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
