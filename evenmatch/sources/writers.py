"""Sinks: partitioned parquet for score tables, CSV for small reports, JSON lines for bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("scorer", "split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_bundle(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").json(path)
