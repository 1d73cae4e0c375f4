"""The tables of queries that each registry module fills."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries by name, their SQL by name, and the decorator that adds to both."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None):
        def register(function):
            queries[function.__name__] = function
            if sql:
                oracle[function.__name__] = sql
            return function

        return register

    return queries, oracle, query
