"""Registering queries with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Queries by name, SQL by name, and the decorator that fills both."""
    queries, sql_of = {}, {}

    def query(sql: str | None = None):
        """Registers a query under its name, with SQL that gives the same rows where there is some."""

        def add(f):
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return add

    return queries, sql_of, query
