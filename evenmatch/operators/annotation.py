"""Annotation samples, rating logs and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.checks import asserted
from ..functions.ordering import hash_position, quantile_row, tie_table, average_rank, with_average_rank
from ..functions.text import order_hash
from ..sources.storage import written
from .resampling import _interval, resample

POOL_ROWS = 300_000  # scores of a pool that are ranked in one task
GROUP_LIMIT = 1000  # up to this rank Spark cuts groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold)


# ------------------------------------------------------------------------------------ sampling
def consensus_scores(scores: DataFrame, scorers: list[str], pool: str = "jd_id", item: str = "bio_id") -> DataFrame:
    """Mean over scorers of the average-rank percentile inside (scorer, pool). A missing scorer fails the job.

    The rows are dealt out by pool and ranked there, in one shuffle. Pools of more than ``POOL_ROWS`` rows
    go through the tie table and are spread over the cluster.
    """
    d = scores.where(F.col("scorer").isin(scorers)).select("scorer", pool, item, "score").where(F.col(pool).isNotNull() & F.col("score").isNotNull())
    large = written(d.groupBy(pool).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > POOL_ROWS).select(pool), "large-pools")
    some = not large.isEmpty()
    per = W.partitionBy(pool, "scorer")
    n, lower = F.count(F.lit(1)).over(W.partitionBy(pool, "scorer", "score")), F.rank().over(per.orderBy("score")).cast("bigint") - 1
    pct = ((lower + (n + 1) / F.lit(2.0)) / F.count(F.lit(1)).over(per)).alias("_pct")
    # a distinct count would be shuffled twice
    seen = sum((F.max((F.col("scorer") == s).cast("int")) for s in dict.fromkeys(scorers)), F.lit(0)).alias("_n")
    mean = lambda x: x.groupBy(pool, item).agg(F.avg("_pct").alias("consensus"), seen)
    c = mean((d.join(large, pool, "left_anti") if some else d).repartition(pool).select("scorer", pool, item, pct))
    if some:
        rest = d.join(large, pool, "left_semi")
        ranks = tie_table(rest, ["scorer", pool], "score").select("scorer", pool, "score", (average_rank() / F.col("total")).alias("_pct"))
        c = c.unionByName(mean(rest.join(ranks, ["scorer", pool, "score"])))
    return asserted(c, F.col("_n") == len(scorers), "a scorer is missing from the scores").drop("_n")


def score_bins(df: DataFrame, value: str = "consensus", cuts=(0.5, 0.9), out: str = "score_bin") -> DataFrame:
    """Bin by quantile cuts; bins are closed on the right and open at both ends of the range."""
    edges = quantile_row(df, value, {f"q{i}": c for i, c in enumerate(cuts)})
    b = F.lit(0)
    for i in range(len(cuts)):
        b = b + (F.col(value) > edges.select(f"q{i}").scalar()).cast("int")
    return df.withColumn(out, b)


def allocate_sample(sizes: DataFrame, key: list[str], n: Column | int, by: list[str] = (), size: str = "size") -> DataFrame:
    """Per stratum ``alloc``: one each, largest first, then proportional to capacity by largest remainder.

    ``sizes`` has one row per stratum (few rows); ``n`` is the budget, per ``by`` group if given.
    """
    by = list(by)
    n = F.lit(n) if isinstance(n, int) else n
    d = sizes.where(F.col(size) > 0).withColumn("_n", n.cast("bigint"))
    big_first = W.partitionBy(*by).orderBy(F.desc(size), *key)
    all_ = W.partitionBy(*by)
    d = d.withColumn("_one", F.when(F.row_number().over(big_first) <= F.col("_n"), 1).otherwise(0))
    d = d.withColumn("_rest", F.greatest(F.col("_n") - F.sum("_one").over(all_), F.lit(0))).withColumn("_cap", F.col(size) - F.col("_one"))
    quota = F.coalesce(F.col("_cap") / F.nullif(F.sum("_cap").over(all_), F.lit(0)) * F.col("_rest"), F.lit(0.0))
    d = d.withColumn("_q", quota).withColumn("_x", F.least(F.floor("_q"), F.col("_cap")))
    d = d.withColumn("_left", F.col("_rest") - F.sum("_x").over(all_)).withColumn("_room", F.col("_x") < F.col("_cap"))
    frac = F.round(F.col("_q") - F.floor("_q"), 9)
    order = W.partitionBy(*by, "_room").orderBy(F.desc(frac), F.desc(size), *key)
    plus = F.when(F.col("_room") & (F.row_number().over(order) <= F.col("_left")), 1).otherwise(0)
    return d.withColumn("alloc", (F.col("_one") + F.col("_x") + plus).cast("bigint")).select(*by, *key, size, "alloc")


def stratified_sample(df: DataFrame, strata: list[str], alloc: DataFrame, seed: int, key: list[str], id_prefix: str = "p") -> DataFrame:
    """Draw each stratum's allocation in seeded order; ids number the sample in another seeded order."""
    hashed, most = df.withColumn("_h", order_hash(seed, *key)), alloc.agg(F.max("alloc")).first()[0] or 0
    if most <= GROUP_LIMIT:  # each task keeps the first rows of a stratum, so the others are never shuffled
        first = hashed.withColumn("_rn", F.row_number().over(W.partitionBy(*strata).orderBy("_h"))).where(F.col("_rn") <= most)
        drawn = first.withColumn("_pos", F.col("_rn") - 1).drop("_rn")
    else:
        drawn = hash_position(hashed, strata, "_h", "_pos")
    sample = drawn.join(alloc.select(*strata, "alloc"), strata).where(F.col("_pos") < F.col("alloc")).drop("_pos", "alloc", "_h")
    # the sample itself is small: its size is the budget
    order = W.orderBy(order_hash(seed + 1, *key))
    return sample.withColumn("pair_id", F.format_string(f"{id_prefix}%03d", F.row_number().over(order) - 1))


def blind_split(sample: DataFrame, jds: DataFrame, bios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what annotators see: id and texts, hidden metadata)."""
    visible = (
        sample.select("pair_id", "jd_id", "bio_id").join(jds.select("jd_id", F.col("text").alias("jd_text")), "jd_id")
        .join(bios.select("bio_id", F.col("text").alias("bio_text")), "bio_id").select("pair_id", "jd_text", "bio_text")
    )
    return visible, sample


# -------------------------------------------------------------------------------------- ratings
def latest_ratings(log: DataFrame, keys=("annotator", "pair_id"), order=("ts",)) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by("rating", F.struct(*order)).alias("rating"))


def ratings_wide(latest: DataFrame, annotators: list[str]) -> DataFrame:
    return latest.groupBy("pair_id").pivot("annotator", annotators).agg(F.first("rating"))


def annotator_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def annotator_order(pairs: DataFrame, annotators: DataFrame, key: str = "pair_id") -> DataFrame:
    """Stable order of all pairs for each annotator. ``annotators`` is a short list by nature."""
    names = annotators.agg(F.sort_array(F.collect_set("annotator")).alias("a"))
    d = pairs.select(key).withColumn("annotator", F.explode(names.scalar()))
    return hash_position(d.withColumn("_h", order_hash("order", "annotator", key)), ["annotator"], "_h", "position").drop("_h")


def annotation_progress(latest: DataFrame, pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    total = pairs.agg(F.count_distinct(key).alias("n")).scalar()
    return latest.groupBy("annotator").agg(F.count_distinct(key).alias("rated")).withColumn("remaining", total - F.col("rated"))


# ------------------------------------------------------------------------------------ agreement
def pairwise_kappa(latest: DataFrame, key: str = "pair_id", min_shared: int = 2) -> DataFrame:
    """Cohen's kappa, plain and quadratic, for every two annotators with enough shared items.

    The items of two annotators are reduced to their confusion cells (at most categories squared);
    the rest is arithmetic on that short array. Weights use label positions.
    """
    a = latest.select(key, F.col("annotator").alias("a"), F.col("rating").alias("ra"))
    b = latest.select(key, F.col("annotator").alias("b"), F.col("rating").alias("rb"))
    cells = a.join(b, key).where("a < b").groupBy("a", "b", "ra", "rb").agg(F.count(F.lit(1)).alias("c"))
    d = cells.groupBy("a", "b").agg(F.sum("c").alias("n"), F.collect_list(F.struct("ra", "rb", "c")).alias("_l"))
    d = d.where(F.col("n") >= min_shared).withColumn(
        "_labels", F.sort_array(F.array_distinct(F.concat(F.transform("_l", lambda x: x["ra"]), F.transform("_l", lambda x: x["rb"])))))
    pos = lambda v: F.array_position("_labels", v)
    plain = lambda x, y: F.when(x == y, 0.0).otherwise(1.0)
    quad = lambda x, y: ((pos(x) - pos(y)) * (pos(x) - pos(y))).cast("double")

    def kappa(w):
        seen = F.aggregate("_l", F.lit(0.0), lambda s, x: s + x["c"] * w(x["ra"], x["rb"]))
        chance = F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.aggregate("_l", F.lit(0.0), lambda t, y: t + x["c"] * y["c"] * w(x["ra"], y["rb"])))
        return 1 - seen / F.nullif(chance / F.col("n"), F.lit(0.0))

    return d.select("a", "b", "n", kappa(plain).alias("kappa"), kappa(quad).alias("kappa_quadratic"))


def krippendorff_ordinal(latest: DataFrame, unit: str = "pair_id") -> DataFrame:
    """Ordinal alpha over units with at least two ratings; one row (alpha, n_units, n_values).

    A unit is reduced to counts per rating value, so the coincidences of a unit with very many
    ratings cost the square of the scale, not of the ratings.
    """
    counts = latest.where(F.col("rating").isNotNull()).groupBy(unit, "rating").agg(F.count(F.lit(1)).alias("c"))
    per_unit = counts.groupBy(unit).agg(F.sum("c").alias("m"), F.collect_list(F.struct("rating", "c")).alias("_l")).where("m >= 2")
    coin = (
        per_unit.select(unit, "m", "_l", F.explode("_l").alias("x")).select(unit, "m", "x", F.explode("_l").alias("y"))
        .groupBy(F.col("x.rating").alias("r1"), F.col("y.rating").alias("r2"))
        .agg(F.sum(F.col("x.c") * (F.col("y.c") - (F.col("x.rating") == F.col("y.rating")).cast("int")) / (F.col("m") - 1)).alias("o"))
    )
    # from here on: one row per pair of rating values
    n_c = coin.groupBy(F.col("r1").alias("r")).agg(F.sum("o").alias("nc"))
    scale = n_c.agg(F.sort_array(F.collect_list(F.struct("r", "nc"))).alias("s"), F.sum("nc").alias("n"))
    both = coin.withColumns({"_s": scale.select("s").scalar(), "_n": scale.select("n").scalar()})
    between = F.aggregate(F.filter("_s", lambda z: z["r"].between(F.least("r1", "r2"), F.greatest("r1", "r2"))), F.lit(0.0), lambda a, z: a + z["nc"])
    own = lambda c: F.get(F.filter("_s", lambda z: z["r"] == F.col(c)), F.lit(0))["nc"]
    d2 = F.pow(between - (own("r1") + own("r2")) / 2, F.lit(2.0))
    delta = F.when(F.col("r1") == F.col("r2"), 0.0).otherwise(d2)
    # pairs of values that never coincide still count in the expected disagreement
    values = scale.select(F.explode("s").alias("x"), F.col("s").alias("_s"), F.col("n").alias("_n")).select("x", "_s", "_n", F.explode("_s").alias("y")).select(
        F.col("x.r").alias("r1"), F.col("y.r").alias("r2"), (F.col("x.nc") * F.col("y.nc")).alias("e"), "_s")
    expected = values.agg(F.sum(F.col("e") * delta).alias("de")).scalar()
    seen = both.agg(F.sum(F.col("o") * delta).alias("do"), F.max("_n").alias("n_values"))
    n_units = per_unit.agg(F.count(F.lit(1)).alias("n")).scalar()
    return seen.select((1 - (F.col("n_values") - 1) * F.col("do") / F.nullif(expected, F.lit(0.0))).alias("alpha"), n_units.alias("n_units"), "n_values")


def spearman(df: DataFrame, x: str, y: str, series: list[str] = ()) -> DataFrame:
    """Spearman's rho on average ranks, NULL pairs dropped; NULL when a side is constant."""
    series = list(series)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*series, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    r = with_average_rank(with_average_rank(d, series, "_x", "_rx"), series, "_y", "_ry")
    spread = F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))
    return r.groupBy(*series).agg((F.covar_pop("_rx", "_ry") / spread).alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_ci(df: DataFrame, x: str, y: str, unit: str, series: list[str] = (), n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """rho with a percentile interval: units are resampled and ranked again in every replicate."""
    series = list(series)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*series, unit, x, y)
    keyed = d if series else d.withColumn("_all", F.lit(0))
    s = series or ["_all"]
    reps = spearman(resample(keyed, s, unit, n_boot, seed), x, y, [*s, "b"])
    out = spearman(keyed, x, y, s).join(_interval(reps.where("rho IS NOT NULL"), s, "rho", alpha), s, "left")
    return out if series else out.drop("_all")


def label_means(rated: DataFrame, label: str = "rel_graded", rating: str = "human_mean") -> DataFrame:
    """Mean human rating per automatic label."""
    return rated.groupBy(label).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(rating).alias("mean_rating"))


def by_rho(correlations: DataFrame, scorer: str = "scorer") -> DataFrame:
    """One row per scorer with its ``place``: the highest correlation first, undefined ones last."""
    return correlations.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("rho"), scorer)).cast("bigint"))
