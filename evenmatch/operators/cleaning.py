"""Cleaning, duplicate removal and seeded splits of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordering import hash_position, quantiles
from ..functions.text import n_words, squash
from ..functions.text import order_hash

SPLIT_ORDER = ("train", "dev", "test")


def filter_short(df: DataFrame, text: str = "text", min_words: int = 5) -> DataFrame:
    return df.where(n_words(F.col(text)) >= min_words)


def drop_missing_and_squash(df: DataFrame, required: list[str], text: str) -> DataFrame:
    return df.na.drop(subset=required).withColumn(text, squash(F.col(text)))


def _text_key(text: str):
    return F.sha2(F.col(text), 256)


def dedup_keep_first(df: DataFrame, within: list[str], text: str = "text", key: str = "bio_id") -> DataFrame:
    """One row per (within, text): the one with the smallest key.

    The texts are reduced to hashes and the copies to one key by a map-side aggregate, so a text
    with very many copies never meets in one task; the rows are then picked by their unique key.
    """
    first = df.groupBy(*within, _text_key(text).alias("_h")).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def split_rank(split: str = "split", order=SPLIT_ORDER):
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))


def drop_cross_split_leaks(df: DataFrame, text: str = "text", key: str = "bio_id", split: str = "split") -> DataFrame:
    """Keep a text only in the earliest split that holds it, and there only its first row."""
    first = (
        df.groupBy(_text_key(text).alias("_h"))
        .agg(F.min(F.struct(split_rank(split).alias("r"), F.col(key).alias("k"))).alias("m"))
        .select(F.col("m.k").alias(key))
    )
    return df.join(first, key, "left_semi")


def clean_texts(df: DataFrame, min_words: int = 5, text: str = "text", key: str = "bio_id", split: str = "split") -> DataFrame:
    """Short, duplicate and leaked rows removed in one pass over the hashes."""
    return drop_cross_split_leaks(filter_short(df, text, min_words), text, key, split)


def cleaning_audit(df: DataFrame, min_words: int = 5, text: str = "text", split: str = "split") -> DataFrame:
    """Per split: raw, too_short, duplicate_in_split, overlaps_earlier_split, kept."""
    copies = df.groupBy(split, _text_key(text).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.max(n_words(F.col(text)) < min_words).alias("short")
    )
    rank = split_rank(split)
    seen = F.min(F.when(~F.col("short"), rank)).over(W.partitionBy("_h"))  # one row per split at most
    flagged = copies.withColumn("leak", ~F.col("short") & (seen < rank))
    return flagged.groupBy(split).agg(
        F.sum("n").alias("raw"),
        F.sum(F.when(F.col("short"), F.col("n")).otherwise(0)).alias("too_short"),
        F.sum(F.when(~F.col("short"), F.col("n") - 1).otherwise(0)).alias("duplicate_in_split"),
        F.sum(F.when(F.col("leak"), 1).otherwise(0)).alias("overlaps_earlier_split"),
        F.sum(F.when(~F.col("short") & ~F.col("leak"), 1).otherwise(0)).alias("kept"),
    )


def stratified_split(
    df: DataFrame, strata: list[str], seed: int, fractions: dict[str, float], key: str = "bio_id", out: str = "new_split"
) -> DataFrame:
    """Seeded re-split: hash order inside each stratum, cut at the rounded fractions (last takes the rest)."""
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    d = hash_position(df.withColumn("_h", order_hash(seed, key)), strata, "_h", "_pos", "_n")
    names = list(fractions)
    cut, expr = F.lit(0.0), None
    for name in names[:-1]:
        cut = cut + F.bround(F.col("_n") * F.lit(fractions[name]))
        expr = F.when(F.col("_pos") < cut, name) if expr is None else expr.when(F.col("_pos") < cut, name)
    return d.withColumn(out, expr.otherwise(names[-1])).drop("_h", "_pos", "_n")


def seeded_subset(df: DataFrame, n: int, seed: int, group: str) -> DataFrame:
    """All rows of the first ``n`` groups in seeded order (a row key as group samples rows)."""
    keep = df.select(group).distinct().withColumn("_h", order_hash(seed, group)).orderBy("_h").limit(n).select(group)
    return df.join(keep, group, "left_semi")


def length_profile(df: DataFrame, text: str = "text", by: str = "split", gender: str = "gender") -> DataFrame:
    d = df.select(by, gender, n_words(F.col(text)).cast("double").alias("_w"))
    mid = quantiles(d, [by], "_w", [0.5]).select(by, F.col("q").alias("median_words"))
    return (
        d.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.avg((F.col(gender) == "F").cast("int")) * 100).alias("pct_f"),
            F.avg("_w").alias("mean_words"),
        )
        .join(mid, by)
    )


def length_counts(df: DataFrame, rows: list[str], splits=SPLIT_ORDER, split: str = "split") -> DataFrame:
    """Row counts with one column per split."""
    return df.groupBy(*rows).pivot(split, list(splits)).count().na.fill(0)
