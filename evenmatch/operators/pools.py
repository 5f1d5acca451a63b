"""Relevance labels and candidate pools.

Pools never cross targets with bios. Bios get a position in hash order inside (class, gender); a
target takes positions from a seeded start, modulo the class size. That is an equi-join on
(class, gender, position) with exactly one bio per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import hash_position
from ..functions.text import hash_number, order_hash


def relevance_binary(jd_class: Column, bio_class: Column) -> Column:
    return (jd_class == bio_class).cast("int")


def class_group(code: Column, level: str = "major") -> Column:
    if level not in ("major", "minor"):
        raise ValueError(f"class codes have major and minor groups, not {level!r}")
    return F.substring(code, 1, 2 if level == "major" else 4)


def relevance_graded(pairs: DataFrame, codes: DataFrame, level: str = "major", jd: str = "jd_occ", bio: str = "bio_occ") -> DataFrame:
    """Add ``rel_graded``: 2 same class, 1 same code group, 0 otherwise. ``codes``: (class, code)."""
    g = codes.select("class", class_group(F.col("code"), level).alias("grp"))
    return (
        pairs.join(g.select(F.col("class").alias(jd), F.col("grp").alias("_gj")), jd)
        .join(g.select(F.col("class").alias(bio), F.col("grp").alias("_gb")), bio)
        .withColumn("rel_graded", F.when(F.col(jd) == F.col(bio), 2).when(F.col("_gj") == F.col("_gb"), 1).otherwise(0))
        .drop("_gj", "_gb")
    )


def related_classes(codes: DataFrame, level: str = "major") -> DataFrame:
    g = codes.select("class", class_group(F.col("code"), level).alias("grp"))
    return g.join(g.select(F.col("class").alias("related"), "grp"), "grp").where("class <> related").select("class", "related")


def select_queries(
    jds: DataFrame, per_class: int, min_per_class: int, dev_fraction: float, seed: int, cls: str = "occ_no", key: str = "jd_id"
) -> DataFrame:
    """Up to ``per_class`` targets of each class with enough of them, the first part for dev."""
    d = hash_position(jds.withColumn("_h", order_hash(seed, key)), [cls], "_h", "_pos", "n_available")
    take = F.least(F.col("n_available"), F.lit(per_class))
    return (
        d.where((F.col("n_available") >= min_per_class) & (F.col("_pos") < take))
        .withColumn("pool_set", F.when(F.col("_pos") < F.bround(take * F.lit(dev_fraction)), "dev").otherwise("test"))
        .drop("_h", "_pos", "n_available")
    )


def query_coverage(jds: DataFrame, selected: DataFrame, cls: str = "occ_no") -> DataFrame:
    used = selected.groupBy(cls).agg(
        F.count(F.lit(1)).alias("used"), F.count_if(F.col("pool_set") == "dev").alias("dev"), F.count_if(F.col("pool_set") == "test").alias("test")
    )
    return jds.groupBy(cls).agg(F.count(F.lit(1)).alias("available")).join(used, cls, "left").na.fill(0, ["used", "dev", "test"])


def _indexed(bios: DataFrame, seed: int) -> DataFrame:
    return hash_position(
        bios.select("bio_id", F.col("bio_occ"), "bio_gender").withColumn("_h", order_hash(seed, "bio_id")),
        ["bio_occ", "bio_gender"], "_h", "idx", "n_class",
    ).drop("_h")


def _class_sizes(bios: DataFrame) -> DataFrame:
    return bios.groupBy("bio_occ", "bio_gender").agg(F.count(F.lit(1)).alias("n"))


def _start(seed: int, *cols) -> Column:
    return hash_number(order_hash(seed, *cols))


def _slots(n: Column) -> Column:
    """0 .. n-1; empty for none."""
    return F.transform(F.array_repeat(F.lit(0), n.cast("int")), lambda _, i: i)


def _require_enough(jds: DataFrame, sizes: DataFrame, half_rel: int, half_irr: int, irrelevant: str) -> None:
    """Raise where a class, or the other classes, have too few bios of a gender for their slots."""
    total = sizes.groupBy("bio_gender").agg(F.map_from_entries(F.collect_list(F.struct("bio_occ", "n"))).alias("of"))
    genders = F.explode(F.array(F.lit("F"), F.lit("M"))).alias("bio_gender")
    want = jds.select("jd_occ").distinct().select("jd_occ", genders).join(total, "bio_gender", "left")
    rest = F.coalesce(F.map_values(F.map_filter("of", lambda k, _: k != F.col("jd_occ"))), F.array().cast("array<bigint>"))
    own = F.coalesce(F.try_element_at("of", F.col("jd_occ")), F.lit(0))
    short = F.aggregate(rest, F.lit(0).cast("bigint"), lambda x, y: x + y) < half_irr
    if irrelevant == "uniform":  # dealt in turn, a class gives up to this many
        short = short | (F.coalesce(F.array_min(rest), F.lit(0)) < F.ceil(F.lit(half_irr) / F.greatest(F.size(rest), F.lit(1))))
    bad = want.where((own < half_rel) | short).select("jd_occ", "bio_gender").orderBy("jd_occ", "bio_gender").limit(5).collect()
    if bad:
        raise ValueError(f"too few bios to fill the pools of (class, gender) {[tuple(r) for r in bad]}")


def build_pools(
    bios: DataFrame, jds: DataFrame, n_candidates: int, n_relevant: int, seed: int, irrelevant: str = "uniform", allow_short: bool = False, codes: DataFrame | None = None,
) -> DataFrame:
    """Long pool table from bios(bio_id, bio_occ, bio_gender) and jds(jd_id, jd_occ).

    Half of the relevant and half of the other candidates are of each gender. ``uniform`` deals the
    other slots to the other classes in turn, in a seeded order per target, so their counts differ
    by at most one (independent draws per slot would be multinomial); ``proportional`` spreads them
    systematically over all other bios. Raises where a class or all others together cannot fill
    their slots; ``allow_short`` leaves such slots empty instead (see ``pool_checks``). With
    ``codes`` (class, code) the table also holds ``rel_graded``.
    """
    if n_relevant % 2 or (n_candidates - n_relevant) % 2:
        raise ValueError("relevant and other slots must each split into two equal halves")
    if irrelevant not in ("uniform", "proportional"):
        raise ValueError(f"other slots are dealt 'uniform' or 'proportional', not {irrelevant!r}")
    half_rel, half_irr = n_relevant // 2, (n_candidates - n_relevant) // 2
    indexed = _indexed(bios, seed)
    sizes = _class_sizes(bios)
    if not allow_short:
        _require_enough(jds, sizes, half_rel, half_irr, irrelevant)
    j = jds.select("jd_id", "jd_occ")

    rel = (
        j.join(sizes.withColumnRenamed("bio_occ", "jd_occ"), "jd_occ")
        .withColumn("slot", F.explode(_slots(F.least(F.lit(half_rel), F.col("n")))))
        .select(
            "jd_id", "jd_occ", F.col("jd_occ").alias("bio_occ"), "bio_gender",
            ((_start(seed, "jd_id", "bio_gender") + F.col("slot")) % F.col("n")).alias("idx"),
        )
    )
    # the class table has one entry per (class, gender): small and bounded by the class list
    classes = sizes.groupBy("bio_gender").agg(F.sort_array(F.collect_list(F.struct("bio_occ", "n"))).alias("classes"))
    per_gender = j.withColumn("bio_gender", F.explode(F.array(F.lit("F"), F.lit("M")))).join(classes, "bio_gender")
    others = per_gender.withColumn("classes", F.filter("classes", lambda c: c["bio_occ"] != F.col("jd_occ"))).where(F.size("classes") > 0)
    if irrelevant == "uniform":
        dealt = others.withColumn(
            "classes",
            F.sort_array(F.transform("classes", lambda c: F.struct(
                order_hash(seed, F.col("jd_id"), c["bio_occ"]).alias("h"), c["bio_occ"].alias("bio_occ"), c["n"].alias("n")))),
        )
        slots = dealt.withColumn("slot", F.explode(_slots(F.lit(half_irr)))).select(
            "jd_id", "jd_occ", "bio_gender",
            F.get("classes", (F.col("slot") % F.size("classes")).cast("int")).alias("c"),
            F.floor(F.col("slot") / F.size("classes")).alias("turn"),
        ).where(F.col("turn") < F.col("c.n"))
        irr = slots.select(
            "jd_id", "jd_occ", F.col("c.bio_occ").alias("bio_occ"), "bio_gender",
            ((_start(seed, F.col("jd_id"), F.col("bio_gender"), F.col("c.bio_occ")) + F.col("turn")) % F.col("c.n")).alias("idx"),
        )
    else:
        total = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
        placed = (
            others.withColumn("m", total)
            .withColumn("slot", F.explode(_slots(F.least(F.lit(half_irr), F.col("m")))))
            .withColumn(
                "at",
                (_start(seed, "jd_id", "bio_gender") + F.floor(F.col("slot") * F.col("m") / F.least(F.lit(half_irr), F.col("m")))) % F.col("m"),
            )
        )
        # walk the class list once: the first class whose running total passes the position
        init = F.struct(F.col("at").alias("left"), F.lit(None).cast("bigint").alias("occ"), F.lit(None).cast("bigint").alias("idx"))
        step = lambda a, c: F.when(a["occ"].isNotNull(), a).otherwise(
            F.when(a["left"] < c["n"], F.struct(a["left"].alias("left"), c["bio_occ"].alias("occ"), a["left"].alias("idx")))
            .otherwise(F.struct((a["left"] - c["n"]).alias("left"), F.lit(None).cast("bigint").alias("occ"), F.lit(None).cast("bigint").alias("idx")))
        )
        irr = placed.withColumn("hit", F.aggregate("classes", init, step)).select(
            "jd_id", "jd_occ", F.col("hit.occ").alias("bio_occ"), "bio_gender", F.col("hit.idx").alias("idx")
        )
    out = rel.unionByName(irr).join(indexed.drop("n_class"), ["bio_occ", "bio_gender", "idx"]).select(
        "jd_id", "jd_occ", "bio_id", "bio_occ", "bio_gender", relevance_binary(F.col("jd_occ"), F.col("bio_occ")).alias("rel_binary")
    )
    return out if codes is None else relevance_graded(out, codes)


def pool_checks(pools: DataFrame, n_candidates: int, n_relevant: int) -> DataFrame:
    """One row per pool with its counts and whether it is sound."""
    c = pools.groupBy("jd_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("bio_id").alias("n_bios"),
        F.count_if(F.col("bio_gender") == "F").alias("n_f"), F.sum("rel_binary").alias("n_rel"),
        F.count_if((F.col("rel_binary") == 1) & (F.col("bio_gender") == "F")).alias("n_rel_f"),
    )
    ok = (
        (F.col("n_rows") == n_candidates) & (F.col("n_bios") == n_candidates) & (F.col("n_f") * 2 == n_candidates)
        & (F.col("n_rel") == n_relevant) & (F.col("n_rel_f") * 2 == n_relevant)
    )
    return c.withColumn("ok", ok)
