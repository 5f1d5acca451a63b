"""Table checks: each returns the violating rows; ``enforce`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, cols: list[str], what: str) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {sorted(df.columns)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def missing_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that have no row in ``other``."""
    return df.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")


def out_of_domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    return df.where(~F.col(col).isin(allowed))


def asserted(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job, at run time and without a driver action, when a row breaks ``condition``."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def enforce(violations: DataFrame, message: str) -> None:
    bad = violations.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")
