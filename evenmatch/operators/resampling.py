"""Bootstrap intervals, sign-flip tests and summaries, with pools (or clusters) as units.

Units are numbered in a seeded hash order, and draw ``i`` of replicate ``b`` is a fixed arithmetic
hash of (b, i), so every interval can be reproduced in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draws import P, draw_sql, mix_sql
from ..functions.ordering import hash_position, quantiles
from ..functions.text import hash_number, order_hash
from ..sources.storage import written

BLOCK = 4096  # units of a series that sit in one row, and slots drawn by one row


def _numbered(units: DataFrame, series: list[str], unit: str, seed: int) -> DataFrame:
    return hash_position(units.withColumn("_h", order_hash(seed, unit)), series, "_h", "_idx", "_n").drop("_h")


def resample(units: DataFrame, series: list[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """Every drawn unit of every replicate: the unit's row plus ``b``.

    Draws depend on the length of a series alone, so series of one length share them. They are generated
    in blocks of slots and equi-joined on (position, length), so a series of any length is spread over the
    cluster. The few lengths would fill one task, so the replicates are dealt out before. The join is a merge
    join whatever the sizes look like: the draws are judged by the lengths and the units by their compressed
    files, and either side would be collected for a broadcast. Aggregate by (series, b) right after.
    """
    return _drawn(_numbered(units, series, unit, seed), n_boot, seed)


def _drawn(d: DataFrame, n_boot: int, seed: int) -> DataFrame:
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = (
        d.select("_n").distinct()
        .withColumn("b", F.explode(F.expr(f"sequence(1L, {n_boot}L)")))
        .withColumn("_blk", F.explode(F.expr(f"sequence(0, (_n - 1) DIV {BLOCK})")))
        .repartition(tasks, "_n", "b", "_blk")
        .withColumn("_i", F.explode(F.expr(f"sequence(_blk * {BLOCK}, least(_n - 1, _blk * {BLOCK} + {BLOCK - 1}))")))
        .select(F.expr(draw_sql("b", "_i", "_n", seed)).alias("_idx"), "_n", "b")
        .repartition("_idx", "_n")
    )
    return draws.hint("merge").join(d, ["_idx", "_n"]).drop("_idx", "_n")


def _interval(reps: DataFrame, series: list[str], value: str, alpha: float) -> DataFrame:
    """Percentile interval per series over the replicates (bounded by n_boot rows)."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    d = reps.groupBy(*series).agg(q.alias("_q"))
    return d.select(*series, F.get("_q", F.lit(0)).alias("ci_low"), F.get("_q", F.lit(1)).alias("ci_high"))


def bootstrap_mean_ci(
    units: DataFrame, series: list[str], unit: str, value: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0, method: str = "exact"
) -> DataFrame:
    """Per series: mean, percentile interval of the resampled means, and the number of units.

    NULL values are dropped first. ``exact`` draws n of n units: a series of up to ``BLOCK`` units is drawn
    inside its row, a longer one as in ``resample``. ``blocks`` and ``poisson`` are for very long series where
    another, cheaper resample is wanted: ``blocks`` first draws how many of a replicate's n draws fall into
    each block of units and makes those inside the block's row, ``poisson`` weights every unit by a
    Poisson(1) count in one pass.
    """
    d = units.where(F.col(value).isNotNull()).select(*series, F.col(unit).alias("_u"), F.col(value).cast("double").alias("_v"))
    point = d.groupBy(*series).agg(F.avg("_v").alias("value"), F.count(F.lit(1)).alias("n_units"))
    if method == "poisson":
        return point.join(_poisson(d, series, n_boot, alpha, seed), series)
    if method == "blocks":
        reps = _replicates(written(_blocks(d, series, seed), "units"), series, n_boot, seed)
    elif method == "exact":
        numbered = written(_numbered(d, series, "_u", seed).drop("_u"), "units")
        reps = _replicates(_in_blocks(numbered.where(F.col("_n") <= BLOCK), series), series, n_boot, seed).unionByName(
            _drawn(numbered.where(F.col("_n") > BLOCK), n_boot, seed).groupBy(*series, "b").agg(F.avg("_v").alias("_r")))
    else:
        raise ValueError("method must be 'exact', 'blocks' or 'poisson'")
    return point.join(_interval(reps, series, "_r", alpha), series)


def _blocks(d: DataFrame, series: list[str], seed: int) -> DataFrame:
    """A row per series and block of units: number of the block, its values in hash order, and the series' length."""
    return _in_blocks(_numbered(d, series, "_u", seed), series)


def _in_blocks(numbered: DataFrame, series: list[str]) -> DataFrame:
    numbered = numbered.withColumn("_c", F.expr(f"_idx DIV {BLOCK}"))
    return numbered.groupBy(*series, "_c").agg(F.sort_array(F.collect_list(F.struct("_idx", "_v"))).alias("_l"), F.max("_n").alias("_n")).select(
        *series, "_c", "_n", F.transform("_l", lambda x: x["_v"]).alias("_a"))


def _replicates(blocks: DataFrame, series: list[str], n_boot: int, seed: int) -> DataFrame:
    """The mean of every replicate of every series as ``_r``.

    The arrays are read inside the generated loops over replicates and draws; what leaves a row are
    its sums per replicate.
    """
    replicate = F.explode(F.expr(f"sequence(1L, {n_boot}L)")).alias("b")
    alone = blocks.where(F.col("_n") <= BLOCK).select(*series, "_c", "_a", F.col("_n").alias("_m"), replicate)
    slots = F.explode(F.expr(f"sequence(_c * {BLOCK}, _c * {BLOCK} + size(_a) - 1)")).alias("_i")
    shares = blocks.where(F.col("_n") > BLOCK).select(*series, "_n", "_c", "_a", replicate).select(*series, "b", "_n", slots)
    shares = shares.groupBy(*series, "b", F.expr(f"{draw_sql('b', '_i', '_n', seed)} DIV {BLOCK}").alias("_c")).agg(F.count(F.lit(1)).alias("_m"))
    parts = alone.unionByName(blocks.select(*series, "_c", "_a").join(shares, [*series, "_c"]).select(alone.columns))
    drawn = parts.select(*series, "b", "_a", "_c", F.explode(F.expr("sequence(0L, _m - 1)")).alias("_j"))
    value = F.expr(f"get(_a, cast({draw_sql('b', f'_c * {BLOCK} + _j', 'size(_a)', seed)} AS int))")
    return drawn.select(*series, "b", value.alias("_x")).groupBy(*series, "b").agg(F.avg("_x").alias("_r"))


def _poisson(d: DataFrame, series: list[str], n_boot: int, alpha: float, seed: int) -> DataFrame:
    # cumulative Poisson(1) probabilities: weight = number of thresholds below a uniform draw
    cum, p, steps = 0.0, 0.36787944117144233, []
    for k in range(12):
        cum += p
        steps.append(cum)
        p /= k + 1
    x = d.withColumn("_k", hash_number(order_hash(seed, "_u")) % P).withColumn("b", F.explode(F.expr(f"sequence(1L, {n_boot}L)")))
    u = F.expr(f"{mix_sql('b', '_k', seed)} / {P}.0D")
    w = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    reps = x.withColumn("_w", w).where("_w > 0").groupBy(*series, "b").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_r"))
    return _interval(reps, series, "_r", alpha)


def bootstrap_ratio_ci(
    clusters: DataFrame, series: list[str], unit: str, sums: list[str], statistic: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0,
    method: str = "percentile",
) -> DataFrame:
    """Interval of ``statistic``, a SQL expression over the summed cluster columns (such as ``hits / n``).

    ``basic`` gives the reverse-percentile interval [2t - high, 2t - low].
    """
    if method not in ("percentile", "basic"):
        raise ValueError("method must be 'percentile' or 'basic'")
    total = lambda df, by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    clusters = written(clusters.select(*series, unit, *sums), "clusters")
    point = total(clusters, series).select(*series, F.expr(statistic).alias("value"))
    n = clusters.groupBy(*series).agg(F.count(F.lit(1)).alias("n_units"))
    reps = total(resample(clusters, series, unit, n_boot, seed), [*series, "b"]).select(*series, F.expr(statistic).alias("_r"))
    d = point.join(n, series).join(_interval(reps.where("_r IS NOT NULL"), series, "_r", alpha), series, "left")
    if method == "basic":
        d = d.withColumns({"ci_low": 2 * F.col("value") - F.col("ci_high"), "ci_high": 2 * F.col("value") - F.col("ci_low")})
    return d


def tpr_gap_ci(counts: DataFrame, series: list[str], unit: str, cls: str, n_boot: int, alpha: float, seed: int) -> DataFrame:
    """Interval of the mean TPR gap over classes, pools resampled; the RMS gap as a point only."""
    cols = ["hit_f", "all_f", "hit_m", "all_m"]
    gap = F.col("hit_f") / F.col("all_f") - F.col("hit_m") / F.col("all_m")

    def per_class(df, by):
        return df.groupBy(*by, cls).agg(*[F.sum(c).alias(c) for c in cols]).where("all_f > 0 AND all_m > 0").withColumn("_g", gap)

    point = per_class(counts, series).groupBy(*series).agg(F.avg("_g").alias("value"), F.sqrt(F.avg(F.col("_g") * F.col("_g"))).alias("rms"))
    reps = per_class(resample(counts, series, unit, n_boot, seed), [*series, "b"]).groupBy(*series, "b").agg(F.avg("_g").alias("_r"))
    return point.join(_interval(reps, series, "_r", alpha), series)


def sign_flip_test(pairs: DataFrame, series: list[str], unit: str, a: str, b: str, n_perm: int = 10000, seed: int = 0) -> DataFrame:
    """Two-sided paired test: mean difference, p value and units. One pass, combined map-side."""
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *series, (F.col(a) - F.col(b)).alias("_d"), (hash_number(order_hash(seed, unit)) % P).alias("_k"))
    point = d.groupBy(*series).agg(F.avg("_d").alias("mean_diff"), F.count(F.lit(1)).alias("n_units"))
    flips = (
        d.withColumn("p", F.explode(F.expr(f"sequence(1L, {n_perm}L)")))
        .select(*series, "p", F.expr(f"CASE WHEN {mix_sql('p', '_k', seed)} % 2 = 0 THEN _d ELSE -_d END").alias("_s"))
        .groupBy(*series, "p").agg(F.sum("_s").alias("_s"))
    )
    obs, null = F.abs("mean_diff"), F.abs(F.col("_s") / F.col("n_units"))
    hits = flips.join(point, series).groupBy(*series).agg(
        F.count_if(null >= obs - F.greatest(F.lit(1e-15), obs * 1e-12)).alias("_hits"))
    return point.join(hits, series).select(*series, "mean_diff", ((1 + F.col("_hits")) / F.lit(1 + n_perm)).alias("p_value"), "n_units")


def holm_adjust(tests: DataFrame, family: list[str], p: str = "p_value", out: str = "p_holm") -> DataFrame:
    """Holm-adjusted p values inside a family (a family is one row per compared scorer)."""
    known = F.col(p).isNotNull()
    w = W.partitionBy(*family, known).orderBy(p)
    m = F.count(F.lit(1)).over(W.partitionBy(*family, known))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    d = tests.withColumn("_raw", raw)
    running = F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(known, running)).drop("_raw")


# ---------------------------------------------------------------------------------- summaries
def unpivot_metrics(per_pool: DataFrame, ids: list[str], skip=("jd_occupation", "n_bios", "pool_sd")) -> DataFrame:
    cols = [c for c in per_pool.columns if c not in ids and c not in skip]
    d = per_pool.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return d.unpivot(ids, [f"`{c}`" for c in cols], "metric", "value").withColumn("metric", F.regexp_replace("metric", "`", ""))


def summarise_metrics(per_pool: DataFrame, series=("scorer", "split", "condition"), unit: str = "jd_id", n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Tidy table: mean and interval per metric; counts (``n_*``) are summed; all-NULL metrics are dropped."""
    series = list(series)
    long = unpivot_metrics(per_pool, [*series, unit]).where("value IS NOT NULL")
    sums = long.where("metric LIKE 'n\\\\_%'").groupBy(*series, "metric").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_units"))
    means = bootstrap_mean_ci(long.where("metric NOT LIKE 'n\\\\_%'"), [*series, "metric"], unit, "value", n_boot, alpha, seed)
    return means.unionByName(sums, allowMissingColumns=True)


def significance_table(per_pool: DataFrame, ours: str, families: list[tuple[str, str]], unit: str = "jd_id", n_perm: int = 10000, seed: int = 0) -> DataFrame:
    """Our scorer against every other on common pools, Holm-adjusted within (condition, metric)."""
    metrics = sorted({m for _, m in families})
    conds = sorted({c for c, _ in families})
    d = per_pool.where(F.col("condition").isin(conds)).select("scorer", "condition", unit, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics])
    long = d.unpivot(["scorer", "condition", unit], [f"`{m}`" for m in metrics], "metric", "value").withColumn("metric", F.regexp_replace("metric", "`", ""))
    wanted = F.concat_ws("\t", "condition", "metric").isin([f"{c}\t{m}" for c, m in families])
    long = long.where(wanted & F.col("value").isNotNull())
    mine = long.where(F.col("scorer") == ours).select("condition", "metric", unit, F.col("value").alias("a"))
    theirs = long.where(F.col("scorer") != ours).select("condition", "metric", unit, F.col("scorer").alias("baseline"), F.col("value").alias("b"))
    both = mine.join(theirs, ["condition", "metric", unit])
    return holm_adjust(sign_flip_test(both, ["condition", "metric", "baseline"], unit, "a", "b", n_perm, seed), ["condition", "metric"])


def seed_mean_sd(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_runs"))


def calibration_quantiles(scores: DataFrame, by: list[str], score: str = "score", grade: str = "rel_graded", n: int = 101) -> DataFrame:
    """Quantile grid, mean and count of the scores: all pairs, and by relevance grade."""
    name = F.when(F.col(grade) == 2, "relevant").when(F.col(grade) == 1, "related").otherwise("irrelevant")
    d = scores.select(*by, F.explode(F.array(F.lit("all"), name)).alias("grp"), F.col(score).cast("double").alias("_s"))
    probs = [i / (n - 1) for i in range(n)]
    q = quantiles(d, [*by, "grp"], "_s", probs).groupBy(*by, "grp").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("quantiles"))
    return q.join(d.groupBy(*by, "grp").agg(F.avg("_s").alias("mean"), F.count(F.lit(1)).alias("n")), [*by, "grp"])


def pool_sd_median(per_pool: DataFrame, by: list[str] = ("scorer",), unit: str = "jd_id", sd: str = "pool_sd") -> DataFrame:
    by = list(by)
    d = per_pool.where(F.col(sd).isNotNull()).groupBy(*by, unit).agg(F.min(sd).alias("_sd"))
    return quantiles(d, by, "_sd", [0.5]).select(*by, F.col("q").alias("pool_sd_median"), F.col("total").alias("n_pools"))


def percentile_of(value: Column, quantile_array: Column) -> Column:
    """Share (0..100) of a calibration distribution at or below ``value``; flat runs count to their end."""
    n = F.size(quantile_array)
    below = F.size(F.filter(quantile_array, lambda q: q <= value))
    lo, hi = F.get(quantile_array, below - 1), F.get(quantile_array, below)
    step = F.lit(100.0) / (n - 1)
    frac = F.when(hi == lo, F.lit(0.0)).otherwise((value - lo) / (hi - lo))
    return (
        F.when(value <= F.get(quantile_array, F.lit(0)), F.lit(0.0))
        .when(value >= F.get(quantile_array, n - 1), F.lit(100.0))
        .otherwise((below - 1) * step + frac * step)
    )


def held_out_groups(per_pool: DataFrame, seen: DataFrame, series: list[str], value: str, unit: str = "jd_id", n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Intervals over units that an earlier run did not use, beside the mean over all units."""
    v = F.col(f"`{value}`")
    d = per_pool.where(v.isNotNull()).select(*series, unit, v.cast("double").alias("value"))
    fresh = bootstrap_mean_ci(d.join(seen.select(unit).distinct(), unit, "left_anti"), series, unit, "value", n_boot, alpha, seed)
    return fresh.join(d.groupBy(*series).agg(F.avg("value").alias("value_all")), series)


def select_variant(variants: DataFrame, metric: str, tie_order: list[str], tolerance: float = 0.005) -> DataFrame:
    """The variant with the best metric; within the tolerance the simplest by ``tie_order`` (ascending)."""
    top = variants.agg(F.max(metric).alias("m")).scalar()
    near = variants.where(F.col(metric) >= top - tolerance)
    return near.orderBy(*tie_order, F.desc(metric)).limit(1)
