"""How a module of jobs names its queries, each with the DuckDB SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from tracklens.fixtures import with_fixtures


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries by name, their SQL, a decorator that registers both)."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str) -> Callable:
        def add(f):
            queries[name], oracle[name] = f, with_fixtures(sql)
            return f

        return add

    return queries, oracle, query
