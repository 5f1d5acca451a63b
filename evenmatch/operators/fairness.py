"""Counterfactual audit: score gaps, rank shifts, TPR gaps and exposure per pool.

Signed quantities are oriented so that positive favours the female-coded (or communal, or target)
version. Gaps are normalised by the standard deviation of the original scores of the whole pool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import asserted
from ..functions.ordering import tie_table
from ..sources.storage import written
from .ranking import expected_position_weights, pool_metrics

CHANGE = "array<struct<kind:string,original:string,replacement:string,start_char:bigint,end_char:bigint,note:string,orig_start:bigint,orig_end:bigint>>"


def orientation_sign(condition: Column, gender: Column, changes: Column, orientation: dict[str, str]) -> Column:
    """+1 or -1 per row. ``orientation``: condition -> gender | communal | target, with a 'default'."""
    kinds = set(orientation.values())
    if not kinds <= {"gender", "communal", "target"}:
        raise ValueError(f"unknown orientation in {sorted(kinds)}")
    n = lambda kind: F.size(F.filter(changes, lambda c: c["kind"] == kind))
    by_kind = {
        "gender": F.when(gender == "M", 1).otherwise(-1),
        "communal": F.when(F.coalesce(n("agentic->communal") >= n("communal->agentic"), F.lit(True)), 1).otherwise(-1),
        "target": F.lit(1),
    }
    out = None
    for cond, kind in orientation.items():
        if cond != "default":
            out = (F.when if out is None else out.when)(condition == cond, by_kind[kind])
    default = by_kind[orientation.get("default", "gender")]
    return default if out is None else out.otherwise(default)


def build_pair_table(pools: DataFrame, rewrites: DataFrame, conditions: list[str], orientation: dict[str, str]) -> DataFrame:
    """One row per (pool, bio, condition), 'original' included. A bio without rewrites fails the job."""
    base = pools.select("jd_id", "bio_id", "bio_gender")
    original = base.select(
        "*", F.lit("original").alias("condition"), F.lit(False).alias("changed"), F.lit(0).alias("sign"), F.lit(None).cast("string").alias("pert_text"))
    want = base.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    r = rewrites.where(F.col("condition").isin(conditions)).select("bio_id", "condition", F.col("text").alias("pert_text"), "changed", "changes", F.lit(True).alias("_found"))
    m = asserted(want.join(r, ["bio_id", "condition"], "left"), F.col("_found"), "a pooled bio has no counterfactual")
    m = m.withColumn("sign", orientation_sign(F.col("condition"), F.col("bio_gender"), F.col("changes"), orientation))
    return original.unionByName(m.select(original.columns))


def score_changed_only(table: DataFrame, bios: DataFrame, jds: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the originals and the changed rewrites; an unchanged rewrite copies its original.

    ``scorer`` gets (jd_id, text_id, jd_text, resume_text) rows, one per distinct pair of texts, and
    returns jd_id, text_id, score and nonempty.
    """
    return score_changed_by(table, bios, jds, {"": scorer}).drop("scorer")


def score_changed_by(table: DataFrame, bios: DataFrame, jds: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``score_changed_only`` for several named scorers, which share the table of text pairs; adds ``scorer``."""
    need = table.where((F.col("condition") == "original") | F.col("changed"))
    need = need.join(bios.select("bio_id", F.col("text").alias("_t")), "bio_id")
    need = need.withColumn("resume_text", F.when(F.col("condition") == "original", F.col("_t")).otherwise(F.col("pert_text")))
    need = written(need.select("jd_id", "bio_id", "condition", F.sha2("resume_text", 256).alias("text_id"), "resume_text"), "need")
    todo = need.dropDuplicates(["jd_id", "text_id"]).select("jd_id", "text_id", "resume_text").join(jds.select("jd_id", F.col("text").alias("jd_text")), "jd_id")
    todo = written(todo, "text-pairs") if len(scorers) > 1 else todo
    scores = None
    for name, scorer in scorers.items():
        one = scorer(todo).select("jd_id", "text_id", F.col("score").cast("double").alias("score"), "nonempty", F.lit(name).alias("scorer"))
        scores = one if scores is None else scores.unionByName(one)
    done = need.select("jd_id", "bio_id", "condition", "text_id").join(scores, ["jd_id", "text_id"]).drop("text_id")
    done = written(done, "scores")
    orig = done.where("condition = 'original'").select("scorer", "jd_id", "bio_id", F.col("score").alias("_s"), F.col("nonempty").alias("_n"))
    every = table.join(orig, ["jd_id", "bio_id"])
    return (
        every.join(done, ["scorer", "jd_id", "bio_id", "condition"], "left")
        .withColumns({"score": F.coalesce("score", "_s"), "nonempty": F.coalesce("nonempty", "_n")}).drop("_s", "_n").select(*table.columns, "scorer", "score", "nonempty")
    )


def rank_shift(rows: DataFrame, pool: list[str], score: str = "score", pert: str = "pert_score", once: tuple[str, str] | None = None) -> DataFrame:
    """Add ``rank_orig`` and ``rank_pert``: ranks of both scores against the other originals.

    The originals and the rewritten scores share one tie table, so a row only looks up two tie
    groups; no pool is joined with itself. ``once``: (column, value) marks one condition whose rows
    list every original exactly once, when ``rows`` repeats the originals per condition.
    """
    originals = rows if once is None else rows.where(F.col(once[0]) == once[1])
    values = originals.select(*pool, F.col(score).alias("_v"), F.lit(1).alias("_o")).unionAll(
        rows.where(F.col(pert) != F.col(score)).select(*pool, F.col(pert).alias("_v"), F.lit(0).alias("_o")))
    t = tie_table(values, pool, "_v", {"o": F.col("_o")}).select(*pool, "_v", F.col("above_o").alias("_a"), F.col("o").alias("_n"))
    # only rows whose score moved look up a second tie group; the id of the pool comes first, so sorts tell rows apart by it
    at, moved = pool[::-1], F.col(pert) != F.col(score)
    second = rows.where(moved).join(t.withColumnsRenamed({"_v": pert, "_a": "_ap", "_n": "_np"}), [*at, pert]).select(*rows.columns, "_ap", "_np")
    none = F.lit(None).cast("bigint")
    both = second.unionByName(rows.where(~moved).select(*rows.columns, none.alias("_ap"), none.alias("_np")))
    d = both.join(t.withColumnsRenamed({"_v": score, "_a": "_ao", "_n": "_no"}), [*at, score])
    d = d.withColumns({"_ap": F.coalesce("_ap", "_ao"), "_np": F.coalesce("_np", "_no")})
    own_above, own_tie = (F.col(score) > F.col(pert)).cast("int"), (F.col(score) == F.col(pert)).cast("int")
    return d.select(
        *rows.columns,
        (1 + F.col("_ao") + (F.col("_no") - 1) / 2.0).alias("rank_orig"),
        (1 + F.col("_ap") - own_above + (F.col("_np") - own_tie) / 2.0).alias("rank_pert"),
    )


def pool_gaps(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Per pool and condition: gap and rank-shift means over all, changed, and changed non-empty bios.

    Input rows carry score, pert_score, sign, changed (0/1), nonempty, pert_nonempty, rank_orig and
    rank_pert. One aggregate; NULL when no bio is in the group or the pool has no spread.
    """
    delta, shift = F.col("pert_score") - F.col("score"), F.col("rank_orig") - F.col("rank_pert")
    changed = F.col("changed") == 1
    both = changed & F.col("nonempty") & F.col("pert_nonempty")
    sd = F.stddev_samp("score")
    safe_sd = F.when(sd > 0, sd)
    aggs = [F.count(F.lit(1)).alias("n_bios"), F.sum(F.when(changed, 1).otherwise(0)).alias("n_changed"), sd.alias("pool_sd")]
    for suffix, mask in (("", F.lit(True)), ("_changed", changed), ("_changed_nonempty", both)):
        mean = lambda c, mask=mask: F.avg(F.when(mask, c))
        aggs += [
            mean(F.abs(delta)).alias(f"abs_gap{suffix}"), mean(F.col("sign") * delta).alias(f"signed_gap{suffix}"),
            (mean(F.abs(delta)) / safe_sd).alias(f"abs_gap_norm{suffix}"), (mean(F.col("sign") * delta) / safe_sd).alias(f"signed_gap_norm{suffix}"),
            mean(F.abs(shift)).alias(f"abs_rank_shift{suffix}"), mean(F.col("sign") * shift).alias(f"signed_rank_shift{suffix}"),
        ]
    aggs.append(F.sum(F.when(both, 1).otherwise(0)).alias("n_changed_nonempty"))
    return ranked.groupBy(*by).agg(*aggs)


def pool_zscores(rows: DataFrame, pool: list[str], score: str = "score", out: str = "z") -> DataFrame:
    """(score - mean) / sd of the pool; NULL for a pool without spread."""
    stats = rows.groupBy(*pool).agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_sd"))
    return rows.join(stats, pool).withColumn(out, (F.col(score) - F.col("_m")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_m", "_sd")


def best_f1_threshold(rows: DataFrame, keys: list[str], z: str = "z", rel: str = "rel_binary", n_grid: int = 200) -> DataFrame:
    """Per key the lowest candidate threshold with the best F1 of ``z >= t``.

    Candidates are the values of a quantile grid. One tie table gives them and their counts: no value
    lies between the two order statistics around a candidate, so the counts at or above it are those
    of the lower one where it equals it, else of the upper one.
    """
    d = rows.where(F.col(z).isNotNull()).select(*keys, F.col(z).cast("double").alias("t"), F.col(rel).alias("r"))
    ties = tie_table(d, keys, "t", {"r": F.col("r")})
    below = F.col("total") - F.col("above") - F.col("n")
    lo, hi = (lambda p: F.floor((F.col("total") - 1) * p)), (lambda p: F.ceil((F.col("total") - 1) * p))
    inside = lambda k: (k >= below) & (k < below + F.col("n"))
    grid = F.array(*[F.lit(i / (n_grid - 1)) for i in range(n_grid)])
    hits = ties.select("*", F.explode(F.filter(grid, lambda p: inside(lo(p)) | inside(hi(p)))).alias("p"))
    at = F.struct("t", (F.col("above") + F.col("n")).alias("n_pred"), (F.col("above_r") + F.col("r")).alias("tp"))
    p = F.col("p")
    ends = hits.groupBy(*keys, "p").agg(F.max(F.when(inside(lo(p)), at)).alias("lo"), F.max(F.when(inside(hi(p)), at)).alias("hi"), F.max("total").alias("total"), F.max("total_r").alias("total_r"))
    frac = (F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)
    t = ends.withColumn("t", F.col("lo.t") + (F.col("hi.t") - F.col("lo.t")) * frac)
    t = t.withColumn("_at", F.when(F.col("t") > F.col("lo.t"), F.col("hi")).otherwise(F.col("lo")))
    tp, n_pred = F.col("_at.tp"), F.col("_at.n_pred")
    f1 = F.when(tp > 0, 2.0 * tp / (n_pred + F.col("total_r")))
    best = F.max(F.struct(F.coalesce(f1, F.lit(-1.0)).alias("f1"), (-F.col("t")).alias("neg_t")))
    agg = t.groupBy(*keys) if keys else t.groupBy()
    return agg.agg(best.alias("b")).select(*keys, (-F.col("b.neg_t")).alias("threshold"), F.col("b.f1").alias("f1"))


def tpr_gap(rows: DataFrame, thresholds: DataFrame, keys: list[str], cls: str = "jd_occupation", z: str = "z") -> DataFrame:
    """Per key and class: TPR_F - TPR_M among relevant pairs, where both genders are present."""
    hit = (F.col(z) >= F.col("threshold")).cast("double")
    tpr = lambda g: F.avg(F.when(F.col("bio_gender") == g, F.coalesce(hit, F.lit(0.0))))
    rel = rows.where("rel_binary = 1").join(thresholds.select(*keys, "threshold"), keys)
    return rel.groupBy(*keys, cls).agg((tpr("F") - tpr("M")).alias("gap")).where("gap IS NOT NULL")


def tpr_gap_summary(gaps: DataFrame, keys: list[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.avg("gap").alias("tpr_gap_mean"), F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("tpr_gap_rms"), F.count(F.lit(1)).alias("n_classes"))


def tpr_counts(rows: DataFrame, thresholds: DataFrame, keys: list[str], pool: str = "jd_id", cls: str = "jd_occupation", z: str = "z") -> DataFrame:
    """Per pool: shortlisted and all relevant bios of each gender (the resampling units of the TPR gap)."""
    hit = F.coalesce((F.col(z) >= F.col("threshold")).cast("int"), F.lit(0))
    is_ = lambda g: (F.col("bio_gender") == g)
    rel = rows.where("rel_binary = 1").join(thresholds.select(*keys, "threshold"), keys)
    return rel.groupBy(*keys, pool, cls).agg(
        F.sum(F.when(is_("F"), hit).otherwise(0)).alias("hit_f"), F.sum(F.when(is_("F"), 1).otherwise(0)).alias("all_f"),
        F.sum(F.when(is_("M"), hit).otherwise(0)).alias("hit_m"), F.sum(F.when(is_("M"), 1).otherwise(0)).alias("all_m"))


def pool_exposure(rows: DataFrame, pool: list[str], k: int = 10, score: str = "score", gender: str = "bio_gender") -> DataFrame:
    """Expected female share of the top k minus one half, plain and position-discounted."""
    w = expected_position_weights(rows, pool, k, score)
    share = lambda c: F.sum(F.when(F.col(gender) == "F", F.col(c)).otherwise(0.0)) / F.sum(c) - 0.5
    return w.groupBy(*pool).agg(
        share("inclusion").alias("topk_female_share_minus_half"), share("discount").alias("exposure_female_share_minus_half"))


def per_pool_metrics(audited: DataFrame, keys: list[str] = ("scorer", "split"), pool: str = "jd_id", exposure_k: int = 10, one_condition: str = "swap") -> DataFrame:
    """All metrics of one pool and condition in a wide row; ranking metrics sit on 'original' rows.

    ``audited`` lists every pair once per condition; ``one_condition`` names one of them.
    """
    by = [*keys, pool]
    originals = audited.where(F.col("condition") == one_condition)
    rank = pool_metrics(originals, by, gender="bio_gender", exposure_k=exposure_k)
    frac = originals.groupBy(*by).agg(F.avg(F.col("nonempty").cast("int")).alias("frac_nonempty"))
    first = rank.join(frac, by).withColumn("condition", F.lit("original"))
    gaps = pool_gaps(rank_shift(audited, by, once=("condition", one_condition)), [*by, "condition"])
    return first.unionByName(gaps, allowMissingColumns=True)
