"""Naming of queries."""

from __future__ import annotations


def registry():
    """Two dictionaries, of queries and their SQL, and a decorator that fills them."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def register(name: str, sql: str | None):
        def keep(query):
            query.__name__ = name
            queries[name] = query
            if sql:
                oracle[name] = sql
            return query

        return keep

    return queries, oracle, register
