"""Keeping the caller's columns apart from those that an operator makes.

An operator works on a table whose own columns have their usual names and all others reserved ones,
so that no extra column can clash with a working column. At the end the caller's names come back;
where the caller has a column of the same name as a result, the result takes its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _inner(docs: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c if c in needed else f"_keep_{i}" for i, c in enumerate(docs.columns)]


def shielded(docs: DataFrame, needed: Sequence[str]) -> DataFrame:
    """``docs`` with all columns but the needed ones under reserved names."""
    return docs.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, _inner(docs, needed), strict=True)])


def restored(out: DataFrame, docs: DataFrame, needed: Sequence[str], own: Sequence[str] = ()) -> DataFrame:
    """The columns of ``docs`` under their names, then the operator's ``own`` ones."""
    back = [F.col(name).alias(c) for c, name in zip(docs.columns, _inner(docs, needed), strict=True) if c not in own]
    return out.select(*back, *own)
