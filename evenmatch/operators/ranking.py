"""Tie-aware ranking metrics: expected values over all orders of equally scored items.

Everything is computed from tie groups (one row per pool and distinct score, see
``functions.ordering``), never from the rows of a whole pool in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import tie_table


def _cumulative(k: int, weight) -> Column:
    """Literal array c where c[m] is the sum of weight(p) over positions 1..m, m = 0..k."""
    sums, total = [0.0], 0.0
    for p in range(1, k + 1):
        total += weight(p)
        sums.append(total)
    return F.array(*[F.lit(s) for s in sums])


def _positions(k: int, weight, n: str = "n", above: str = "above") -> Column:
    """Sum of weight over the positions of a tie group that are <= k."""
    c = _cumulative(k, weight)
    at = lambda m: F.get(c, F.least(m, F.lit(k)).cast("int"))
    return at(F.col(above) + F.col(n)) - at(F.col(above))


def position_weight(k: int, discounted: bool) -> Column:
    """Mean weight of an item of a tie group: 1/log2(p+1) or 1 for positions p <= k, else 0."""
    w = (lambda p: 1.0 / math.log2(p + 1)) if discounted else (lambda p: 1.0)
    return _positions(k, w) / F.col("n")


def require_scores(df: DataFrame, score: str = "score") -> DataFrame:
    # the check wraps the value itself, so no later filter on the score can drop the bad row first
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return df.withColumn(score, F.when(ok, F.col(score)).otherwise(F.raise_error(F.lit("scores contain NULL or NaN")).cast("double")))


def tie_groups(df: DataFrame, pool: list[str], score: str = "score") -> DataFrame:
    """(pool, score, start, size) of each group of equal scores, best first."""
    return tie_table(require_scores(df, score), pool, score).select(*pool, score, (F.col("above") + 1).alias("start"), F.col("n").alias("size"))


def expected_ranks(df: DataFrame, pool: list[str], score: str = "score") -> DataFrame:
    g = tie_groups(df, pool, score).select(*pool, score, (F.col("start") + (F.col("size") - 1) / 2).alias("expected_rank"))
    return df.join(g, [*pool, score])


def expected_position_weights(df: DataFrame, pool: list[str], k: int, score: str = "score") -> DataFrame:
    """Rows + ``inclusion`` and ``discount``: expected top-k membership and discounted gain weight."""
    g = tie_table(require_scores(df, score), pool, score).select(
        *pool, score, position_weight(k, False).alias("inclusion"), position_weight(k, True).alias("discount"))
    return df.join(g, [*pool, score])


def reciprocal_rank_of(start: Column, g: Column, r: Column) -> Column:
    """Expected 1/position of the first of r relevant items in a tie group of g at ``start``.

    Walks the offsets with p(1) = r/g and p(j+1) = p(j) (g-j-r+1)/(g-j). The walk ends where the
    remaining probability is below the rounding of a double, so its length is about 60 g/r.
    """
    steps = F.least(g - r + 1, F.ceil(g * 60.0 / r) + 64).cast("int")
    init = F.struct((r / g).cast("double").alias("p"), F.lit(0.0).alias("s"))
    step = lambda a, j: F.struct(
        (a["p"] * (g - j - r + 1) / F.when(g - j > 0, g - j).otherwise(1)).alias("p"), (a["s"] + a["p"] / (start + j - 1)).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), steps), init, step, lambda a: a["s"])


def pool_metrics(
    df: DataFrame, pool: list[str], score: str = "score", binary: str = "rel_binary", graded: str = "rel_graded", ks=(5, 10), k: int = 10,
    gender: str | None = None, exposure_k: int = 10,
) -> DataFrame:
    """ndcg@k graded and binary, reciprocal rank, precision at each cut, and exposure when ``gender`` is given."""
    gain = lambda c: F.pow(F.lit(2.0), F.col(c)) - 1
    sums = {"rel": F.col(binary), "gain_g": gain(graded), "gain_b": gain(binary)}
    if gender:
        sums["n_f"] = (F.col(gender) == "F").cast("int")
    ties = tie_table(require_scores(df, score), pool, score, sums)
    dcg = position_weight(k, True)
    aggs = [
        F.sum(F.col("gain_g") * dcg).alias("_dcg_g"), F.sum(F.col("gain_b") * dcg).alias("_dcg_b"),
        F.min(F.when(F.col("rel") > 0, F.struct("above", "n", "rel"))).alias("_first"), F.sum("rel").alias("_rel"),
        *[(F.sum(F.col("rel") * position_weight(c, False)) / c).alias(f"p@{c}") for c in ks],
    ]
    if gender:
        inc, dis = position_weight(exposure_k, False), position_weight(exposure_k, True)
        aggs += [
            (F.sum(F.col("n_f") * inc) / F.sum(F.col("n") * inc) - 0.5).alias("topk_female_share_minus_half"),
            (F.sum(F.col("n_f") * dis) / F.sum(F.col("n") * dis) - 0.5).alias("exposure_female_share_minus_half"),
        ]
    per_pool = ties.groupBy(*pool).agg(*aggs)
    ideal = (
        tie_table(df.select(*pool, gain(graded).alias("g")), pool, "g")
        .groupBy(*pool).agg(F.sum(F.col("g") * _positions(k, lambda p: 1.0 / math.log2(p + 1))).alias("_idcg_g"))
    )
    # binary gains are 0 or 1, so the ideal only needs the number of relevant items
    c = _cumulative(k, lambda p: 1.0 / math.log2(p + 1))
    d = per_pool.join(ideal, pool)
    f = F.col("_first")
    rr = reciprocal_rank_of(f["above"] + 1, f["n"], f["rel"])
    idcg_b = F.get(c, F.least(F.col("_rel"), F.lit(k)).cast("int"))
    return d.select(
        *pool,
        (F.col("_dcg_g") / F.nullif(F.col("_idcg_g"), F.lit(0.0))).alias(f"ndcg@{k}"),
        (F.col("_dcg_b") / F.nullif(idcg_b, F.lit(0.0))).alias(f"ndcg@{k}_binary"),
        F.when(f.isNull(), F.lit(0.0)).otherwise(rr).alias("mrr"),
        *[f"p@{c}" for c in ks],
        *(["topk_female_share_minus_half", "exposure_female_share_minus_half"] if gender else []),
    )


def pool_auc(df: DataFrame, pool: list[str], score: str = "score", binary: str = "rel_binary") -> DataFrame:
    """P(relevant outscores irrelevant) + half the ties, from counts below (no pair join)."""
    t = tie_table(df, pool, score, {"rel": F.col(binary)})
    irr_below = (F.col("total") - F.col("total_rel")) - (F.col("above") - F.col("above_rel")) - (F.col("n") - F.col("rel"))
    wins = F.sum(F.col("rel") * (irr_below + (F.col("n") - F.col("rel")) / 2.0))
    n_pos, n_neg = F.max("total_rel"), F.max(F.col("total") - F.col("total_rel"))
    return t.groupBy(*pool).agg((wins / F.nullif(n_pos * n_neg, F.lit(0))).alias("auc"))


def scorer_summary(df: DataFrame, scorer: str = "scorer", pool: str = "jd_id", score: str = "score", binary: str = "rel_binary", nonempty: str = "nonempty") -> DataFrame:
    """Per scorer: mean pool AUC, mean score by relevance, NULL and empty counts."""
    auc = pool_auc(df, [scorer, pool], score, binary).groupBy(scorer).agg(F.avg("auc").alias("mean_pool_auc"))
    stats = df.groupBy(scorer).agg(
        F.count_if(F.col(score).isNull()).alias("n_null"), F.count_if(~F.col(nonempty)).alias("n_empty"),
        F.avg(F.when(F.col(binary) == 1, F.col(score))).alias("score_mean_rel"), F.avg(F.when(F.col(binary) == 0, F.col(score))).alias("score_mean_irrel"))
    return stats.join(auc, scorer)
