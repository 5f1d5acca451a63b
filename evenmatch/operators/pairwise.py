"""Incremental scoring, several scorers in one long table, and top-k lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

Scorer = Callable[[DataFrame], DataFrame]


class ScorerRegistry:
    """Named scorers: each maps a pair table to the same pairs with a ``score`` column."""

    def __init__(self):
        self._scorers: dict[str, tuple[Scorer, bool]] = {}

    def register(self, name: str, scorer: Scorer, enabled: bool = True) -> "ScorerRegistry":
        if name in self._scorers:
            raise ValueError(f"scorer {name!r} registered twice")
        self._scorers[name] = (scorer, enabled)
        return self

    def names(self) -> list[str]:
        return [n for n, (_, on) in self._scorers.items() if on]

    def score(self, pairs: DataFrame) -> DataFrame:
        """Long table (scorer, pair columns, score) of all enabled scorers."""
        out = None
        for name in self.names():
            d = self._scorers[name][0](pairs).withColumn("scorer", F.lit(name))
            out = d if out is None else out.unionByName(d)
        if out is None:
            raise ValueError("no scorer is enabled")
        return out


def incremental_pair_scores(pairs: DataFrame, store: DataFrame | None, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """(scores of all pairs, new rows for the store), keyed by the two text hashes.

    A stored NULL is a result: the pair is not scored again.
    """
    keys = ["jd_hash", "bio_hash"]
    distinct = pairs.dropDuplicates(keys)
    todo = distinct if store is None else distinct.join(store.select(*keys), keys, "left_anti")
    fresh = scorer(todo).select(*keys, "score")
    known = fresh if store is None else store.select(*keys, "score").unionByName(fresh)
    return pairs.join(known, keys), fresh


def topk_candidates(scored: DataFrame, k: int, by: list[str] = ("jd_id",), tie: str = "bio_id") -> DataFrame:
    """Top-k rows per key. The rank filter is applied before the shuffle as well, so a hot key stays small."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
