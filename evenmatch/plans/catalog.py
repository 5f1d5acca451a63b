"""Registry of named queries: ``key -> (function of Tables, SQL it must equal or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add
