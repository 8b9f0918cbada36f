"""How a module of plans registers its queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries and oracles by name, and the decorator ``query(name, sql)`` that adds to them."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(function):
            queries[name] = function
            if sql is not None:
                oracles[name] = sql
            return function

        return add

    return queries, oracles, query
