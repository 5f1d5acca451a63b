"""Late interaction between the entities of a target and of a bio.

Each document's entities are gathered into one array, so a pair is two joins by id and everything
after them is computed inside the row: the similarity matrix of a pair is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import rows
from .dense import dot


def entity_bags(entities: DataFrame, key: str, extra: tuple[str, ...] = (), pos: str = "pos", ent: str = "ent_key", vec: str = "embedding") -> DataFrame:
    """(key, ents): array of struct(pos, ent, vec, extra...) in order of first mention."""
    item = F.struct(F.col(pos).alias("pos"), F.col(ent).alias("ent"), F.col(vec).alias("vec"), *[F.col(c) for c in extra])
    return entities.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("ents"))


def first_mentions(entities: DataFrame, key: str, ent: str = "ent_key", pos: str = "pos") -> DataFrame:
    """First mention of each distinct entity of a document."""
    cols = [c for c in entities.columns if c not in (key, ent)]
    return entities.groupBy(key, ent).agg(F.min_by(F.struct(*cols), pos).alias("m")).select(key, ent, "m.*")


def joined_bags(pairs: DataFrame, jd_bags: DataFrame, bio_bags: DataFrame, how: str = "inner") -> DataFrame:
    return pairs.join(jd_bags.select("jd_id", F.col("ents").alias("jd_ents")), "jd_id", how).join(
        bio_bags.select("bio_id", F.col("ents").alias("bio_ents")), "bio_id", how
    )


def _sims(j: Column, extra: tuple[str, ...] = ()) -> Column:
    """Similarities of one target entity, as sortable structs: best first means greatest."""
    return F.transform("bio_ents", lambda e: F.struct(
        dot(j["vec"], e["vec"]).alias("sim"), (-e["pos"]).alias("neg_pos"), e["ent"].alias("bio_ent"), *[e[c].alias(f"bio_{c}") for c in extra]))


def entity_similarity(joined: DataFrame) -> DataFrame:
    """Long similarity rows: (jd_id, bio_id, jd_ent, bio_ent, sim)."""
    cells = F.flatten(F.transform("jd_ents", lambda j: F.transform(
        "bio_ents", lambda e: F.struct(j["ent"].alias("jd_ent"), e["ent"].alias("bio_ent"), dot(j["vec"], e["vec"]).alias("sim")))))
    return joined.select("jd_id", "bio_id", F.explode(cells).alias("r")).select("jd_id", "bio_id", "r.*")


def best_matches(joined: DataFrame, jd_extra: tuple[str, ...] = (), bio_extra: tuple[str, ...] = ()) -> DataFrame:
    """Add ``best``: per target entity the most similar bio entity (ties: the first mentioned)."""
    def one(j):
        m = F.array_max(_sims(j, bio_extra))
        return F.struct(j["pos"].alias("j_pos"), j["ent"].alias("jd_ent"), m.alias("m"), *[j[c].alias(f"jd_{c}") for c in jd_extra])

    flat = lambda b: F.struct(
        b["j_pos"].alias("j_pos"), b["jd_ent"].alias("jd_ent"), b["m"]["bio_ent"].alias("bio_ent"), b["m"]["sim"].alias("sim"),
        *[b[f"jd_{c}"].alias(f"jd_{c}") for c in jd_extra], *[b["m"][f"bio_{c}"].alias(f"bio_{c}") for c in bio_extra])
    d = joined.withColumn("_b", F.transform("jd_ents", one))
    return d.withColumn("best", F.transform("_b", flat)).drop("_b")


def maxsim_mean(best: str = "best") -> Column:
    return F.aggregate(best, F.lit(0.0), lambda a, b: a + b["sim"]) / F.size(best)


def threshold_fraction(threshold: float = 0.55, best: str = "best") -> Column:
    return F.size(F.filter(best, lambda b: b["sim"] >= threshold)) / F.size(best).cast("double")


def idf_weighted_maxsim(best: str = "best", weight: str = "jd_weight") -> Column:
    """Weighted mean of the best similarities; fails on a negative weight or where all weights are zero."""
    total = F.aggregate(best, F.lit(0.0), lambda a, b: a + b[weight])
    good = F.forall(best, lambda b: b[weight] >= 0) & ((total > 0) | (F.size(best) == 0))
    value = F.aggregate(best, F.lit(0.0), lambda a, b: a + b[weight] * b["sim"]) / F.nullif(total, F.lit(0.0))
    return F.when(good, value).otherwise(F.raise_error(F.lit("weights must not be negative, nor all zero")).cast("double"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def assignment_sum(sims: Column) -> Column:
    """Greatest sum of similarities in a matrix (array of rows) where every row or every column, whichever are fewer, is used once.

    Rows enter one by one; each looks for the cheapest augmenting path under potentials of rows and
    columns, so the cost is cubic in the side of a bag and no signs or sizes are special.
    """
    def of(cost: Column) -> Column:
        n, m = F.size(cost), F.size(F.get(cost, F.lit(0)))
        index = lambda k: F.sequence(F.lit(0), k)
        column = lambda v, least, used, way, row: F.struct(v.alias("v"), least.alias("least"), used.alias("used"), way.alias("way"), row.alias("row"))
        none, zero, no = F.lit(None).cast("double"), F.lit(0.0), F.lit(False)
        start = F.struct(F.transform(index(n), lambda _: zero).alias("u"), F.transform(index(m), lambda _: column(zero, none, no, F.lit(0), F.lit(0))).alias("c"))

        def step(s: Column) -> Column:
            """The nearest column not yet used joins the tree of the row that is being placed."""
            at = F.get(s["c"], s["at"])["row"]
            row = F.get(cost, at - 1)

            def reached(x: Column, j: Column) -> Column:
                used = x["used"] | (j == s["at"])
                new = F.get(row, j - 1) - F.get(s["u"], at) - x["v"]
                closer = ~used & (j > 0) & (x["least"].isNull() | (new < x["least"]))
                return column(x["v"], F.when(closer, new).otherwise(x["least"]), used, F.when(closer, s["at"]).otherwise(x["way"]), x["row"])

            def moved(c: Column) -> Column:
                free = F.transform(c, lambda x, j: F.when(~x["used"] & (j > 0), F.struct(x["least"].alias("least"), j.alias("j"))))

                def by(best: Column) -> Column:
                    inside = F.transform(F.filter(c, lambda x: x["used"]), lambda x: x["row"])
                    u = F.transform(s["u"], lambda x, i: F.when(F.array_contains(inside, i), x + best["least"]).otherwise(x))
                    cols = F.transform(c, lambda x: F.when(x["used"], column(x["v"] - best["least"], x["least"], x["used"], x["way"], x["row"])).otherwise(
                        column(x["v"], x["least"] - best["least"], x["used"], x["way"], x["row"])))
                    return F.struct(u.alias("u"), cols.alias("c"), best["j"].alias("at"), (F.get(c, best["j"])["row"] == 0).alias("done"))

                return _let(F.array_min(free), by)

            return _let(F.transform(s["c"], reached), moved)

        def augmented(s: Column) -> Column:
            """The path back from the free column hands every row on it to its next column."""
            def back(x: Column, _: Column) -> Column:
                prev = F.get(x["c"], x["at"])["way"]
                taken = F.get(x["c"], prev)["row"]
                cols = F.transform(x["c"], lambda y, j: F.when(j == x["at"], column(y["v"], y["least"], y["used"], y["way"], taken)).otherwise(y))
                return F.when(x["at"] == 0, x).otherwise(F.struct(cols.alias("c"), prev.alias("at")))

            done = F.aggregate(index(m), F.struct(s["c"].alias("c"), s["at"].alias("at")), back, lambda x: x["c"])
            return F.struct(s["u"].alias("u"), done.alias("c"))

        def placed(s: Column, i: Column) -> Column:
            fresh = F.transform(s["c"], lambda x, j: column(x["v"], none, no, F.lit(0), F.when(j == 0, i).otherwise(x["row"])))
            first = F.struct(s["u"].alias("u"), fresh.alias("c"), F.lit(0).alias("at"), no.alias("done"))
            return _let(F.aggregate(index(m), first, lambda x, _: F.when(x["done"], x).otherwise(step(x))), augmented)

        total = lambda s: F.aggregate(
            F.transform(s["c"], lambda x, j: F.when((j > 0) & (x["row"] > 0), F.get(F.get(cost, x["row"] - 1), j - 1)).otherwise(zero)), zero, lambda a, x: a - x)
        return F.aggregate(F.sequence(F.lit(1), n), start, placed, total)

    def oriented(rows: Column) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        turned = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))
        return _let(F.when(F.size(rows) <= width, rows).otherwise(turned), of)

    negated = F.transform(sims, lambda row: F.transform(row, lambda x: -x))
    return F.when((F.size(sims) > 0) & (F.size(F.get(sims, F.lit(0))) > 0), _let(negated, oriented))


def one_to_one_match() -> Column:
    """Optimal one-to-one assignment over ``jd_ents`` x ``bio_ents``: sum of its similarities / target entities."""
    sims = F.transform("jd_ents", lambda j: F.transform("bio_ents", lambda e: dot(j["vec"], e["vec"])))
    return assignment_sum(sims) / F.size("jd_ents")


def entity_idf(
    jd_entities: DataFrame, targets: DataFrame, key: str = "jd_id", ent: str = "ent_key", text_hash: str = "text_hash"
) -> tuple[DataFrame, DataFrame]:
    """(ent, idf) over the distinct target texts, and one row with the idf of unseen entities.

    ``targets`` (key, hash of the text) lists all targets: one without entities counts as a document,
    and targets with equal texts are one document.
    """
    texts = targets.groupBy(text_hash).agg(F.min(key).alias(key))
    n = texts.agg(F.count(F.lit(1)).alias("n_docs"))
    df = jd_entities.select(key, ent).distinct().join(texts.select(key), key, "left_semi").groupBy(ent).agg(F.count(F.lit(1)).alias("df"))
    table = df.select(ent, "df", (F.log((n.scalar() + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return table, n.select("n_docs", (F.log(F.col("n_docs") + 1) + 1).alias("unseen"))


def with_entity_weights(jd_entities: DataFrame, idf: DataFrame, unseen: DataFrame, ent: str = "ent_key") -> DataFrame:
    """Add ``weight``: the fitted idf, or the unseen one."""
    return jd_entities.join(idf.select(ent, "idf"), ent, "left").withColumn("weight", F.coalesce("idf", unseen.select("unseen").scalar())).drop("idf")


def empty_policy(pairs: DataFrame, jd_bags: DataFrame, bio_bags: DataFrame, score: Column, jd_extra: tuple[str, ...] = ()) -> DataFrame:
    """pairs + score + nonempty; a pair with an empty side scores 0 and is flagged."""
    d = best_matches(joined_bags(pairs, jd_bags, bio_bags, "left"), jd_extra)
    ok = (F.coalesce(F.size("jd_ents"), F.lit(0)) > 0) & (F.coalesce(F.size("bio_ents"), F.lit(0)) > 0)
    return d.withColumn("nonempty", ok).select(*pairs.columns, F.when(F.col("nonempty"), score).otherwise(F.lit(0.0)).alias("score"), "nonempty")


def explain_matches(best: DataFrame) -> DataFrame:
    """Long form of ``best``: one row per target entity."""
    return best.select("jd_id", "bio_id", rows("best").alias("b")).select("jd_id", "bio_id", "b.*")


def requirement_report(best: DataFrame, weight: str = "jd_weight", top: int | None = None, order: str = "lost") -> DataFrame:
    """Per target entity: weight share, best match, contribution, loss, and its rank in the pair.

    ``order``: the greatest loss first (``lost``), the greatest weight (``weight``), or the least similarity (``sim``); ties by first mention.
    """
    first = {"lost": lambda b: -(b[weight] / F.col("_w")) * (1 - b["sim"]), "weight": lambda b: -b[weight], "sim": lambda b: b["sim"]}
    if order not in first:
        raise ValueError(f"requirements are ordered by {sorted(first)}, not {order!r}")
    total = F.aggregate("best", F.lit(0.0), lambda a, b: a + b[weight])
    parts = F.transform("best", lambda b: F.struct(
        first[order](b).alias("first"), b["j_pos"].alias("j_pos"), b["jd_ent"].alias("jd_ent"), b["bio_ent"].alias("bio_ent"),
        b["sim"].alias("sim"), (b[weight] / F.col("_w")).alias("weight"), (b[weight] / F.col("_w") * b["sim"]).alias("contribution")))
    d = best.withColumn("_w", total).withColumn("_r", F.sort_array(parts))
    d = d.withColumn("score", F.aggregate("_r", F.lit(0.0), lambda a, r: a + r["contribution"]))
    shown = F.slice("_r", F.lit(1), F.lit(top) if top else F.size("_r"))
    return d.select("jd_id", "bio_id", "score", F.posexplode(shown).alias("p", "r")).select(
        "jd_id", "bio_id", "score", (F.col("p") + 1).cast("bigint").alias("rank"), "r.jd_ent", "r.bio_ent", "r.sim", "r.weight", "r.contribution",
        (F.col("r.weight") * (1 - F.col("r.sim"))).alias("lost"))


def matched_gaps_suggestions(best: DataFrame, match: float = 0.55, near: float = 0.35) -> DataFrame:
    """Older report: per pair matched, gaps, near misses and the percentage matched (one decimal)."""
    n = lambda cond: F.size(F.filter("best", cond)).cast("bigint")
    names = lambda cond: F.array_join(F.sort_array(F.transform(F.filter("best", cond), lambda b: b["jd_ent"])), ",")
    matched, near_miss = (lambda b: b["sim"] >= match), (lambda b: (b["sim"] >= near) & (b["sim"] < match))
    return best.select(
        "jd_id", "bio_id", n(matched).alias("total_matched"), F.size("best").cast("bigint").alias("total_requirements"),
        F.bround(n(matched) / F.size("best") * 100, 1).alias("match_percent"),
        names(matched).alias("matched"), names(lambda b: b["sim"] < match).alias("gaps"), names(near_miss).alias("suggestions"),
    )
