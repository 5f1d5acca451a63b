"""Report tables over the tidy metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _three_decimals(name: str):
    """printf('%.3f'): rounded from the number itself, where format_string rounds its shortest decimal form half up."""
    # format_number takes 0.0005, a little more than its name, for a tie
    v = f"CASE WHEN abs({name}) >= 0.0005D AND abs({name}) < 0.001D THEN signum({name}) * 0.001D ELSE {name} END"
    return F.expr(f"format_number({v}, '0.000')")


def _cell():
    value, low, high = map(_three_decimals, ("value", "ci_low", "ci_high"))
    return F.when(F.col("ci_low").isNull(), value).otherwise(F.concat(value, F.lit(" ["), low, F.lit(", "), high, F.lit("]")))


def metric_pivot(tidy: DataFrame, metric: str, conditions: list[str], split: str = "test", mark: str | None = None) -> DataFrame:
    """scorer x condition table of one metric, 'v [low, high]' cells, a dash where it is missing."""
    d = tidy.where((F.col("metric") == metric) & (F.col("split") == split))
    cell = F.concat(_cell(), F.coalesce(F.col(mark), F.lit(""))) if mark else _cell()
    return d.select("scorer", "condition", cell.alias("cell")).groupBy("scorer").pivot("condition", conditions).agg(F.first("cell")).na.fill("-", conditions)


def significance_marks(tidy: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``mark``: a dagger where the scorer differs from ours after Holm adjustment."""
    t = tests.select("condition", "metric", F.col("baseline").alias("scorer"), "p_holm")
    return tidy.join(t, ["scorer", "condition", "metric"], "left").withColumn("mark", F.when(F.col("p_holm") < alpha, "†").otherwise("")).drop("p_holm")


def ablation_table(tidy: DataFrame, variants: dict[str, str], reference: str, accuracy: str, coverage: str, gap: str, conditions: list[str], split: str = "test") -> DataFrame:
    """Per variant: accuracy, coverage, one gap per condition, and whether it is the reference."""
    d = tidy.where((F.col("split") == split) & F.col("scorer").isin(list(variants)))
    pick = lambda c, m: F.max(F.when((F.col("condition") == c) & (F.col("metric") == m), F.col("value")))
    names = F.create_map(*[x for k, v in variants.items() for x in (F.lit(k), F.lit(v))])
    return d.groupBy("scorer").agg(
        pick("original", accuracy).alias("accuracy"), pick("original", coverage).alias("coverage"), *[pick(c, gap).alias(f"gap_{c}") for c in conditions],
    ).withColumns({"label": names[F.col("scorer")], "is_reference": F.col("scorer") == reference})


def dataset_profile(bios: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, name, n): rows per split, pools per class, pools and pairs in all."""
    per_split = bios.groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("rows"))
    pools = pairs.groupBy("pool_set", "jd_occ", "jd_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    sets = pools.groupingSets([["jd_occ"], ["pool_set"], []], "jd_occ", "pool_set").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_pairs").alias("n_pairs"), F.grouping_id().alias("g"))
    kind = F.when(F.col("jd_occ").isNotNull(), "pools_of_class").when(F.col("pool_set").isNotNull(), "pools_of_set").otherwise("pools")
    name = F.coalesce(F.col("jd_occ").cast("string"), "pool_set", F.lit("all"))
    return per_split.select("kind", "name", "n").unionByName(sets.select(kind.alias("kind"), name.alias("name"), "n")).unionByName(
        sets.where("jd_occ IS NULL AND pool_set IS NULL").select(F.lit("pairs").alias("kind"), F.lit("all").alias("name"), F.col("n_pairs").alias("n")))


def headline_points(tidy: DataFrame, families: dict[str, str], x_metric: str, y_condition: str, y_metric: str, split: str = "test") -> DataFrame:
    """(scorer, family, x and y with intervals): accuracy against the gap of one condition."""
    d = tidy.where(F.col("split") == split)
    pick = lambda c, m, p: d.where((F.col("condition") == c) & (F.col("metric") == m)).select(
        "scorer", F.col("value").alias(p), F.col("ci_low").alias(f"{p}_lo"), F.col("ci_high").alias(f"{p}_hi"))
    fam = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.lit(v))])
    return pick("original", x_metric, "x").join(pick(y_condition, y_metric, "y"), "scorer").withColumn("family", F.coalesce(fam[F.col("scorer")], F.lit("neural")))


def artifact_bundle(idf: DataFrame, calibration: DataFrame, pool_sd: DataFrame, band: DataFrame) -> DataFrame:
    """Everything a matcher needs as rows ``part, name, value``: idf of the entities, calibration, pool SDs, chosen band.

    A vocabulary of any size stays a table; no part is gathered into one row.
    """
    label = F.concat_ws("/", "scorer", "grp")
    number = lambda d, part, name, value: d.select(F.lit(part).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    quantiles = calibration.select(label.alias("l"), F.posexplode("quantiles").alias("p", "q"))
    return (
        number(idf, "idf", F.col("ent_key"), F.col("idf"))
        .unionByName(number(calibration, "mean", label, F.col("mean")))
        .unionByName(number(calibration, "n", label, F.col("n")))
        .unionByName(number(quantiles, "quantile", F.concat_ws("/", "l", "p"), F.col("q")))
        .unionByName(number(pool_sd, "pool_sd_median", F.col("scorer"), F.col("pool_sd_median")))
        .unionByName(number(band, "band", F.lit("lo"), F.col("lo"))).unionByName(number(band, "band", F.lit("hi"), F.col("hi")))
    )
