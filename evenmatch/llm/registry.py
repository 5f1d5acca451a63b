"""Registry of the queries of this package: ``name -> function of (spark, folder)`` and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function under ``name`` with the SQL that it must equal, if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    importlib.import_module(f"{__package__}.catalog")
    return QUERIES, SQL
