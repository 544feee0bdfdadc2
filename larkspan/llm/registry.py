"""The queries of this package, by name."""

from __future__ import annotations

from larkspan.llm import queries


def collected() -> tuple[dict, dict]:
    return queries.QUERIES, queries.SQL
