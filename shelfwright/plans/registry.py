"""Registered queries and their SQL twins. Importing the query modules fills both dictionaries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that says the same."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import queries_catalog, queries_functions, queries_maintained, queries_rules, queries_sources, queries_streams, queries_tree, queries_text  # noqa: E402, F401
