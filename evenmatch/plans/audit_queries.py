"""Ranking metrics, counterfactual audit and resampling statistics as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import P, draw_sql, mix_sql
from ..functions.ordering import quantiles
from ..operators import fairness as H, ranking as R, resampling as J
from ..sources.storage import written
from .catalog import query
from .views import sql_view, with_views as V

r6 = lambda c, name=None: F.round(F.col(f"`{c}`") if isinstance(c, str) else c, 6).alias(name or c)
POOL = ["scorer", "split", "jd_id"]
N_BOOT, N_PERM, SEED = 200, 500, 17

# -------------------------------------------------------------------------------------- ranking
sql_view("rk", ("sl",), """SELECT *, rank() OVER (PARTITION BY scorer, jd_id ORDER BY score DESC) AS st, count(*) OVER (PARTITION BY scorer, jd_id, score) AS n FROM sl""")
# expected weight of an item at cut 10 and 5
sql_view("wt", ("rk",), """SELECT *, CASE WHEN st > 10 THEN 0 ELSE list_sum(list_transform(range(st, least(st + n - 1, 10) + 1), lambda p: 1 / log2(p + 1))) / n END AS dis,
  greatest(least(st + n - 1, 10) - st + 1, 0) / n AS inc, greatest(least(st + n - 1, 5) - st + 1, 0) / n AS inc5 FROM rk""")
sql_view("idc2", ("sl",), """SELECT scorer, jd_id, sum(CASE WHEN rn <= 10 THEN (2 ** rel_graded - 1) / log2(rn + 1) END) AS idcg, sum(CASE WHEN rb <= 10 THEN (2 ** rel_binary - 1) / log2(rb + 1) END) AS idcg_b
  FROM (SELECT *, row_number() OVER (PARTITION BY scorer, jd_id ORDER BY rel_graded DESC) AS rn, row_number() OVER (PARTITION BY scorer, jd_id ORDER BY rel_binary DESC) AS rb FROM sl) GROUP BY 1, 2""")
_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
sql_view("rr", ("rk",), f"""SELECT scorer, jd_id, CASE WHEN r IS NULL THEN 0 ELSE list_sum(list_transform(range(1, n - r + 2), lambda j:
  exp({_LC.format(n='(n - j)', k='(r - 1)')} - {_LC.format(n='n', k='r')}) / (st + j - 1))) END AS mrr FROM (
  SELECT scorer, jd_id, min(st) FILTER (r > 0) AS st, arg_min(n, st) FILTER (r > 0) AS n, arg_min(r, st) FILTER (r > 0) AS r FROM (
  SELECT scorer, jd_id, st, n, sum(rel_binary)::bigint AS r FROM rk GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)""")
sql_view("rm", ("wt", "idc2", "rr"), """SELECT w.scorer, any_value(w.split) AS split, w.jd_id, any_value(w.jd_occupation) AS jd_occupation, sum((2 ** rel_graded - 1) * dis) / nullif(any_value(idcg), 0) AS ndcg,
  sum((2 ** rel_binary - 1) * dis) / nullif(any_value(idcg_b), 0) AS ndcg_b, any_value(mrr) AS mrr, sum(rel_binary * inc5) / 5 AS p5, sum(rel_binary * inc) / 10 AS p10,
  sum(CASE WHEN bio_gender = 'F' THEN inc ELSE 0 END) / sum(inc) - 0.5 AS top_f, sum(CASE WHEN bio_gender = 'F' THEN dis ELSE 0 END) / sum(dis) - 0.5 AS exp_f, avg(nonempty::int) AS frac
  FROM wt w JOIN idc2 i ON i.scorer = w.scorer AND i.jd_id = w.jd_id JOIN rr ON rr.scorer = w.scorer AND rr.jd_id = w.jd_id GROUP BY w.scorer, w.jd_id""")


@query("tie_groups", V("rk", "SELECT DISTINCT scorer, split, jd_id, score, st AS start, n AS size FROM rk"))
def _(t):
    return R.tie_groups(t.scores_long(), POOL)


@query("expected_ranks", V("rk", """SELECT scorer, jd_id, count(*) AS n_rows, round(sum((st + (n - 1) / 2) * (bio_id % 97)), 6) AS rank_check FROM rk GROUP BY 1, 2"""))
def _(t):
    d = R.expected_ranks(t.scores_long(), POOL)
    return d.groupBy("scorer", "jd_id").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum(F.col("expected_rank") * (F.col("bio_id") % 97)), "rank_check"))


@query("expected_position_weights", V("wt", """SELECT scorer, jd_id, bio_id, round(inc, 6) AS inclusion, round(dis, 6) AS discount FROM wt WHERE inc > 0"""))
def _(t):
    d = R.expected_position_weights(t.scores_long(), POOL, 10).where("inclusion > 0")
    return d.select("scorer", "jd_id", "bio_id", r6("inclusion"), r6("discount"))


def ranking_metrics(t):
    return R.pool_metrics(t.scores_long(), POOL, gender="bio_gender")


@query("ndcg_at_k", V("rm", 'SELECT scorer, jd_id, round(ndcg, 6) AS "ndcg@10", round(ndcg_b, 6) AS "ndcg@10_binary" FROM rm'))
def _(t):
    return ranking_metrics(t).select("scorer", "jd_id", r6("ndcg@10"), r6("ndcg@10_binary"))


@query("precision_at_k", V("rm", 'SELECT scorer, jd_id, round(p5, 6) AS "p@5", round(p10, 6) AS "p@10" FROM rm'))
def _(t):
    return ranking_metrics(t).select("scorer", "jd_id", r6("p@5"), r6("p@10"))


@query("reciprocal_rank", V("rr", "SELECT scorer, jd_id, round(mrr, 6) AS mrr FROM rr"))
def _(t):
    return ranking_metrics(t).select("scorer", "jd_id", r6("mrr"))


@query("ranking_metrics", V("rm", """SELECT scorer, split, jd_id, round(ndcg, 6) AS "ndcg@10", round(ndcg_b, 6) AS "ndcg@10_binary", round(mrr, 6) AS mrr, round(p5, 6) AS "p@5", round(p10, 6) AS "p@10" FROM rm"""))
def _(t):
    return ranking_metrics(t).select(*POOL, *[r6(c) for c in ("ndcg@10", "ndcg@10_binary", "mrr", "p@5", "p@10")])


sql_view("auc", ("sl",), """SELECT scorer, jd_id, sum(rel * (irr_below + (n - rel) / 2)) / nullif(any_value(tr) * any_value(tn), 0) AS auc FROM (
  SELECT *, coalesce(sum(n - rel) OVER (PARTITION BY scorer, jd_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS irr_below,
  sum(rel) OVER (PARTITION BY scorer, jd_id) AS tr, sum(n - rel) OVER (PARTITION BY scorer, jd_id) AS tn FROM
  (SELECT scorer, jd_id, score, count(*) AS n, sum(rel_binary) AS rel FROM sl GROUP BY 1, 2, 3)) GROUP BY 1, 2""")


@query("pool_auc", V("auc", "SELECT scorer, jd_id, round(auc, 6) AS auc FROM auc"))
def _(t):
    return R.pool_auc(t.scores_long(), POOL).select("scorer", "jd_id", r6("auc"))


@query("scorer_summary", V("auc sl", """SELECT s.scorer, count_if(score IS NULL) AS n_null, count_if(NOT nonempty) AS n_empty, round(avg(score) FILTER (rel_binary = 1), 6) AS score_mean_rel,
 round(avg(score) FILTER (rel_binary = 0), 6) AS score_mean_irrel, round(any_value(a.m), 6) AS mean_pool_auc FROM sl s JOIN (SELECT scorer, avg(auc) AS m FROM auc GROUP BY 1) a USING (scorer) GROUP BY 1"""))
def _(t):
    d = R.scorer_summary(t.scores_long())
    return d.select("scorer", "n_null", "n_empty", r6("score_mean_rel"), r6("score_mean_irrel"), r6("mean_pool_auc"))


# --------------------------------------------------------------------------------------- audit
sql_view("og", ("sl",), "SELECT scorer, jd_id, score AS v, count(*) AS c FROM sl GROUP BY 1, 2, 3")
sql_view("probe", ("au", "og"), """SELECT p.scorer, p.jd_id, p.val, coalesce(sum(c) FILTER (v > val), 0) AS gt, coalesce(sum(c) FILTER (v = val), 0) AS eq FROM
  (SELECT scorer, jd_id, score AS val FROM au UNION SELECT scorer, jd_id, pert_score FROM au) p JOIN og USING (scorer, jd_id) GROUP BY 1, 2, 3""")
sql_view("rs", ("au", "probe"), """SELECT a.*, 1 + o.gt + (o.eq - 1) / 2 AS rank_orig, 1 + p.gt - (a.score > a.pert_score)::int + (p.eq - (a.score = a.pert_score)::int) / 2 AS rank_pert
  FROM au a JOIN probe o ON o.scorer = a.scorer AND o.jd_id = a.jd_id AND o.val = a.score JOIN probe p ON p.scorer = a.scorer AND p.jd_id = a.jd_id AND p.val = a.pert_score""")
_GAPS = []
for suf, m in (("", "true"), ("_changed", "changed = 1"), ("_changed_nonempty", "changed = 1 AND nonempty AND pert_nonempty")):
    _GAPS += [
        f"avg(abs(pert_score - score)) FILTER ({m}) AS abs_gap{suf}", f"avg(sign * (pert_score - score)) FILTER ({m}) AS signed_gap{suf}",
        f"avg(abs(pert_score - score)) FILTER ({m}) / nullif(stddev_samp(score), 0) AS abs_gap_norm{suf}",
        f"avg(sign * (pert_score - score)) FILTER ({m}) / nullif(stddev_samp(score), 0) AS signed_gap_norm{suf}",
        f"avg(abs(rank_orig - rank_pert)) FILTER ({m}) AS abs_rank_shift{suf}", f"avg(sign * (rank_orig - rank_pert)) FILTER ({m}) AS signed_rank_shift{suf}",
    ]
sql_view("gaps", ("rs",), f"""SELECT scorer, split, jd_id, condition, count(*) AS n_bios, sum(changed)::bigint AS n_changed, stddev_samp(score) AS pool_sd, {', '.join(_GAPS)},
  count_if(changed = 1 AND nonempty AND pert_nonempty) AS n_changed_nonempty FROM rs GROUP BY 1, 2, 3, 4""")
KINDS = ("abs_gap", "signed_gap", "abs_gap_norm", "signed_gap_norm", "abs_rank_shift", "signed_rank_shift")


def ranked(t):
    return H.rank_shift(t.audited(), POOL, once=("condition", "swap"))


def gaps(t):
    return H.pool_gaps(ranked(t), [*POOL, "condition"])


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("rank_shift", V("rs", """SELECT scorer, condition, jd_id, round(sum(rank_orig * (bio_id % 89)), 4) AS orig_check, round(sum(rank_pert * (bio_id % 89)), 4) AS pert_check FROM rs GROUP BY 1, 2, 3"""))
def _(t):
    w = F.col("bio_id") % 89
    return ranked(t).groupBy("scorer", "condition", "jd_id").agg(
        F.round(F.sum(F.col("rank_orig") * w), 4).alias("orig_check"), F.round(F.sum(F.col("rank_pert") * w), 4).alias("pert_check"))


_MAIN = ["pool_sd", *KINDS, *[f"{k}_changed" for k in KINDS]]


@query("pool_gaps", V("gaps", f"SELECT scorer, split, jd_id, condition, n_bios, n_changed, {_rounded(_MAIN)} FROM gaps"))
def _(t):
    return gaps(t).select(*POOL, "condition", "n_bios", "n_changed", *[r6(c) for c in _MAIN])


_NE = [f"{k}_changed_nonempty" for k in KINDS]


@query("pool_gaps_nonempty", V("gaps", f"SELECT scorer, jd_id, condition, n_changed_nonempty, {_rounded(_NE)} FROM gaps"))
def _(t):
    return gaps(t).select("scorer", "jd_id", "condition", "n_changed_nonempty", *[r6(c) for c in _NE])


sql_view("z", ("sl",), """SELECT *, (score - avg(score) OVER (PARTITION BY scorer, jd_id)) / nullif(stddev_samp(score) OVER (PARTITION BY scorer, jd_id), 0) AS z FROM sl""")


def zscores(t):
    return H.pool_zscores(t.scores_long(), POOL)


@query("pool_zscores", V("z", "SELECT scorer, jd_id, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(sum(z * (bio_id % 83)), 4) AS z_check FROM z GROUP BY 1, 2"))
def _(t):
    return zscores(t).groupBy("scorer", "jd_id").agg(r6(F.min("z"), "z_min"), r6(F.max("z"), "z_max"), F.round(F.sum(F.col("z") * (F.col("bio_id") % 83)), 4).alias("z_check"))


# z values are rounded so that both engines see the same ties
sql_view("zr", ("z",), "SELECT * EXCLUDE (z), round(z, 6) AS z FROM z")
GRID = 200
sql_view("thr", ("zr",), f"""SELECT scorer, arg_max(t, struct_pack(f1, nt := -t)) AS threshold, max(f1) AS f1 FROM (SELECT scorer, t, CASE WHEN tp > 0 THEN round(2 * tp / (np + nr), 12) ELSE -1 END AS f1 FROM (
  SELECT c.scorer, c.t, sum(g.n) FILTER (g.z >= c.t) AS np, sum(g.r) FILTER (g.z >= c.t) AS tp, sum(g.r) AS nr FROM
  (SELECT DISTINCT scorer, unnest(quantile_cont(z, {[i / (GRID - 1) for i in range(GRID)]})) AS t FROM zr WHERE split = 'dev' GROUP BY 1) c
  JOIN (SELECT scorer, z, count(*) AS n, sum(rel_binary) AS r FROM zr WHERE split = 'dev' AND z IS NOT NULL GROUP BY 1, 2) g USING (scorer) GROUP BY 1, 2)) GROUP BY 1""")


def dev_thresholds(t):
    z = written(zscores(t).withColumn("z", F.round("z", 6)), "zscores")
    return z, H.best_f1_threshold(z.where("split = 'dev'"), ["scorer"])


@query("best_f1_threshold", V("thr", "SELECT scorer, round(threshold, 5) AS threshold, round(f1, 6) AS f1 FROM thr"))
def _(t):
    return dev_thresholds(t)[1].select("scorer", F.round("threshold", 5).alias("threshold"), r6("f1"))


sql_view("tg", ("zr", "thr"), """SELECT scorer, jd_occupation, avg((z >= threshold)::int) FILTER (bio_gender = 'F') - avg((z >= threshold)::int) FILTER (bio_gender = 'M') AS gap FROM zr JOIN thr USING (scorer)
  WHERE split = 'test' AND rel_binary = 1 GROUP BY 1, 2""")


@query("tpr_gap", V("tg", """SELECT scorer, jd_occupation, round(gap, 6) AS gap, round(avg(gap) OVER (PARTITION BY scorer), 6) AS tpr_gap_mean,
 round(sqrt(avg(gap * gap) OVER (PARTITION BY scorer)), 6) AS tpr_gap_rms FROM tg WHERE gap IS NOT NULL"""))
def _(t):
    z, thr = dev_thresholds(t)
    per = H.tpr_gap(z.where("split = 'test'"), thr, ["scorer"])
    return per.join(H.tpr_gap_summary(per, ["scorer"]), "scorer").select("scorer", "jd_occupation", r6("gap"), r6("tpr_gap_mean"), r6("tpr_gap_rms"))


sql_view("tc_", ("zr", "thr"), """SELECT scorer, jd_id, jd_occupation, count_if(bio_gender = 'F' AND z >= threshold) AS hf, count_if(bio_gender = 'F') AS af, count_if(bio_gender = 'M' AND z >= threshold) AS hm,
  count_if(bio_gender = 'M') AS am, row_number() OVER (PARTITION BY scorer ORDER BY sha256('17|' || jd_id::varchar)) - 1 AS idx, count(*) OVER (PARTITION BY scorer) AS n FROM zr JOIN thr USING (scorer)
  WHERE split = 'test' AND rel_binary = 1 GROUP BY scorer, jd_id, jd_occupation, threshold""")


@query("tpr_gap_ci", V("tc_", f"""SELECT p.scorer, round(p.value, 6) AS value, round(p.rms, 6) AS rms, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM
 (SELECT scorer, avg(g) AS value, sqrt(avg(g * g)) AS rms FROM (SELECT scorer, jd_occupation, sum(hf) / nullif(sum(af), 0) - sum(hm) / nullif(sum(am), 0) AS g FROM tc_ GROUP BY 1, 2) WHERE g IS NOT NULL GROUP BY 1) p JOIN
 (SELECT scorer, b, avg(g) AS r FROM (SELECT u.scorer, d.b, u.jd_occupation, sum(hf) / nullif(sum(af), 0) - sum(hm) / nullif(sum(am), 0) AS g FROM
   (SELECT s.scorer, b, {draw_sql('b', 'i', 'n', SEED)} AS idx FROM (SELECT DISTINCT scorer, n FROM tc_) s, range(1, {N_BOOT + 1}) AS x(b), LATERAL (SELECT unnest(range(n)) AS i) y) d
   JOIN tc_ u ON u.scorer = d.scorer AND u.idx = d.idx GROUP BY 1, 2, 3) WHERE g IS NOT NULL GROUP BY 1, 2) q USING (scorer) GROUP BY 1, 2, 3"""))
def _(t):
    z, thr = dev_thresholds(t)
    counts = H.tpr_counts(z.where("split = 'test'"), thr, ["scorer"])
    d = J.tpr_gap_ci(counts, ["scorer"], "jd_id", "jd_occupation", N_BOOT, 0.05, SEED)
    return d.select("scorer", r6("value"), r6("rms"), r6("ci_low"), r6("ci_high"))


@query("pool_exposure", V("rm", "SELECT scorer, split, jd_id, round(top_f, 6) AS topk_female_share_minus_half, round(exp_f, 6) AS exposure_female_share_minus_half FROM rm"))
def _(t):
    d = H.pool_exposure(t.scores_long(), POOL)
    return d.select(*POOL, r6("topk_female_share_minus_half"), r6("exposure_female_share_minus_half"))


sql_view("pp", ("rm", "gaps"), """SELECT scorer, split, jd_id, 'original' AS condition, round(ndcg, 6) AS "ndcg@10", round(ndcg_b, 6) AS "ndcg@10_binary", round(mrr, 6) AS mrr, round(p5, 6) AS "p@5",
  round(p10, 6) AS "p@10", round(top_f, 6) AS topk_female_share_minus_half, round(exp_f, 6) AS exposure_female_share_minus_half, round(frac, 6) AS frac_nonempty,
  NULL::double AS pool_sd, NULL::bigint AS n_changed, NULL::double AS abs_gap_norm_changed, NULL::double AS signed_gap_norm_changed, NULL::double AS abs_rank_shift_changed, NULL::double AS abs_gap_norm_changed_nonempty FROM rm
  UNION ALL SELECT scorer, split, jd_id, condition, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(pool_sd, 6), n_changed, round(abs_gap_norm_changed, 6), round(signed_gap_norm_changed, 6),
  round(abs_rank_shift_changed, 6), round(abs_gap_norm_changed_nonempty, 6) FROM gaps""")
PP = ["ndcg@10", "ndcg@10_binary", "mrr", "p@5", "p@10", "topk_female_share_minus_half", "exposure_female_share_minus_half", "frac_nonempty", "pool_sd",
      "abs_gap_norm_changed", "signed_gap_norm_changed", "abs_rank_shift_changed", "abs_gap_norm_changed_nonempty"]


def per_pool(t):
    d = H.per_pool_metrics(t.audited())
    return d.select(*POOL, "condition", "n_changed", *[r6(c) for c in PP])


@query("per_pool_metrics", V("pp", "SELECT * FROM pp"))
def _(t):
    return per_pool(t)


ORIENT = {"swap": "gender", "words": "communal", "name": "target", "default": "gender"}


@query("orientation_sign", V("v5", """SELECT condition, bio_gender, bio_id % 3 AS kind, count(*) AS n_rows, sum(CASE condition WHEN 'words' THEN CASE WHEN bio_id % 3 = 0 THEN -1 ELSE 1 END
 WHEN 'name' THEN 1 ELSE CASE WHEN bio_gender = 'M' THEN 1 ELSE -1 END END)::bigint AS total FROM v5, (VALUES ('swap'), ('words'), ('name'), ('other')) AS c(condition) GROUP BY 1, 2, 3"""))
def _(t):
    change = lambda kind: F.struct(F.lit(kind).alias("kind"))
    a2c, c2a = change("agentic->communal"), change("communal->agentic")
    d = t.scored().select("bio_gender", "bio_id", F.explode(F.array(*[F.lit(c) for c in ("swap", "words", "name", "other")])).alias("condition"))
    changes = F.when(F.col("bio_id") % 3 == 0, F.array(a2c, c2a, c2a)).otherwise(F.array(c2a, a2c))
    d = d.withColumn("sign", H.orientation_sign(F.col("condition"), F.col("bio_gender"), changes, ORIENT))
    return d.groupBy("condition", "bio_gender", (F.col("bio_id") % 3).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sign").alias("total"))


# ---------------------------------------------------------------------------------- resampling
def _boot_sql(src: str, series: str, value: str = "v") -> str:
    """Means of resampled units: ``src`` has the series columns, jd_id and the value column."""
    return f"""u AS (SELECT *, row_number() OVER (PARTITION BY {series} ORDER BY sha256('{SEED}|' || jd_id::varchar)) - 1 AS idx, count(*) OVER (PARTITION BY {series}) AS n FROM {src} WHERE {value} IS NOT NULL),
 lists AS (SELECT {series}, list({value} ORDER BY idx) AS l, count(*) AS n FROM u GROUP BY ALL),
 reps AS (SELECT {series}, n, list_avg(list_transform(range(n), lambda i: l[1 + {draw_sql('b', 'i', 'n', SEED)}])) AS r FROM lists, range(1, {N_BOOT + 1}) AS x(b)),
 ci AS (SELECT {series}, any_value(n) AS n_units, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high FROM reps GROUP BY ALL),
 means AS (SELECT {series}, avg({value}) AS value FROM u GROUP BY ALL)"""


@query("bootstrap_mean_ci", V("pp", f""", src AS (SELECT scorer, split, jd_id, "ndcg@10" AS v FROM pp WHERE condition = 'original'),
 {_boot_sql('src', 'scorer, split')} SELECT scorer, split, round(value, 6) AS value, n_units, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci JOIN means USING (scorer, split)"""))
def _(t):
    d = written(ranking_metrics(t).select("scorer", "split", "jd_id", r6("ndcg@10", "v")), "units")
    return J.bootstrap_mean_ci(d, ["scorer", "split"], "jd_id", "v", N_BOOT, 0.05, SEED).select("scorer", "split", r6("value"), "n_units", r6("ci_low"), r6("ci_high"))


@query("bootstrap_ratio_ci", V("sl", f""", src AS (SELECT scorer, jd_id, sum(rel_binary)::double AS num, count(*)::double AS den FROM sl WHERE split = 'test' GROUP BY 1, 2),
 u AS (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY sha256('{SEED}|' || jd_id::varchar)) - 1 AS idx, count(*) OVER (PARTITION BY scorer) AS n FROM src),
 d AS (SELECT s.scorer, b, {draw_sql('b', 'i', 'n', SEED)} AS idx FROM (SELECT DISTINCT scorer, n FROM u) s, range(1, {N_BOOT + 1}) AS x(b), LATERAL (SELECT unnest(range(n)) AS i) y),
 r AS (SELECT u.scorer, b, sum(num) / sum(den) AS r FROM d JOIN u ON u.scorer = d.scorer AND u.idx = d.idx GROUP BY 1, 2),
 p AS (SELECT scorer, sum(num) / sum(den) AS value, count(*) AS n_units FROM src GROUP BY 1)
 SELECT p.scorer, round(value, 6) AS value, n_units, round(2 * value - quantile_cont(r, 0.975), 6) AS ci_low, round(2 * value - quantile_cont(r, 0.025), 6) AS ci_high FROM p JOIN r USING (scorer) GROUP BY scorer, value, n_units"""))
def _(t):
    c = t.scores_long().where("split = 'test'").groupBy("scorer", "jd_id").agg(F.sum("rel_binary").cast("double").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    d = J.bootstrap_ratio_ci(c, ["scorer"], "jd_id", ["num", "den"], "num / den", N_BOOT, 0.05, SEED, "basic")
    return d.select("scorer", r6("value"), "n_units", r6("ci_low"), r6("ci_high"))


_KEY = f"(('0x' || substr(sha256('{SEED}|' || jd_id::varchar), 1, 12))::bigint % {P})"
sql_view("sig_in", ("pp",), """SELECT 'original' AS condition, 'ndcg@10' AS metric, o.scorer AS baseline, a.jd_id, a."ndcg@10" - o."ndcg@10" AS d FROM pp a JOIN pp o ON o.jd_id = a.jd_id AND o.scorer <> 'a'
   AND o.condition = 'original' WHERE a.scorer = 'a' AND a.condition = 'original' AND a.split = 'test' AND a."ndcg@10" IS NOT NULL AND o."ndcg@10" IS NOT NULL
  UNION ALL SELECT a.condition, 'abs_gap_norm_changed', o.scorer, a.jd_id, a.abs_gap_norm_changed - o.abs_gap_norm_changed FROM pp a JOIN pp o ON o.jd_id = a.jd_id AND o.scorer <> 'a' AND o.condition = a.condition
   WHERE a.scorer = 'a' AND a.condition IN ('swap', 'noop') AND a.split = 'test' AND a.abs_gap_norm_changed IS NOT NULL AND o.abs_gap_norm_changed IS NOT NULL""")
sql_view("sig0", ("sig_in",), f"""SELECT condition, metric, baseline, mean_diff, (1 + count_if(abs(s / n) >= abs(mean_diff) - greatest(1e-15, abs(mean_diff) * 1e-12))) / {1 + N_PERM} AS p_value, n AS n_units FROM (
  SELECT condition, metric, baseline, p, avg(d) AS mean_diff, count(*) AS n, sum(CASE WHEN {mix_sql('p', _KEY, SEED)} % 2 = 0 THEN d ELSE -d END) AS s FROM sig_in, range(1, {N_PERM + 1}) AS x(p) GROUP BY 1, 2, 3, 4) GROUP BY ALL""")
_HOLM = "max(least(1, (m - rn + 1) * p_value)) OVER (PARTITION BY condition, metric ORDER BY p_value ROWS UNBOUNDED PRECEDING)"
sql_view("sig", ("sig0",), f"""SELECT *, {_HOLM} AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY condition, metric ORDER BY p_value) AS rn, count(*) OVER (PARTITION BY condition, metric) AS m FROM sig0)""")
FAMILIES = [("original", "ndcg@10"), ("swap", "abs_gap_norm_changed"), ("noop", "abs_gap_norm_changed")]


@query("sign_flip_test", V("sig0", "SELECT baseline, round(mean_diff, 6) AS mean_diff, round(p_value, 6) AS p_value, n_units FROM sig0 WHERE metric = 'ndcg@10'"))
def _(t):
    m = written(ranking_metrics(t).where("split = 'test'").select("scorer", "jd_id", r6("ndcg@10", "v")), "units")
    both = m.where("scorer = 'a'").select("jd_id", F.col("v").alias("a")).join(m.where("scorer <> 'a'").select("jd_id", F.col("scorer").alias("baseline"), F.col("v").alias("b")), "jd_id")
    d = J.sign_flip_test(both, ["baseline"], "jd_id", "a", "b", N_PERM, SEED)
    return d.select("baseline", r6("mean_diff"), r6("p_value"), "n_units")


@query("holm_adjust", V("v5", """, t AS (SELECT jd_occupation AS family, jd_id, CASE WHEN jd_id % 9 = 4 THEN NULL ELSE avg(changed) * (0.01 + (jd_id % 5) / 100) END AS p FROM v5 GROUP BY 1, 2)
 SELECT family, jd_id, round(p, 6) AS p_value, round(CASE WHEN p IS NOT NULL THEN max(least(1, (m - rn + 1) * p)) OVER (PARTITION BY family, p IS NULL ORDER BY p, jd_id ROWS UNBOUNDED PRECEDING) END, 6) AS p_holm FROM (
 SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, jd_id) AS rn, count(*) OVER (PARTITION BY family, p IS NULL) AS m FROM t)"""))
def _(t):
    d = t.scored().groupBy(F.col("jd_occupation").alias("family"), "jd_id").agg(F.avg("changed").alias("m"))
    d = d.withColumn("p_value", F.when(F.col("jd_id") % 9 != 4, F.col("m") * (0.01 + (F.col("jd_id") % 5) / 100)))
    return J.holm_adjust(d, ["family"]).select("family", "jd_id", r6("p_value"), r6("p_holm"))


_SM = ['"ndcg@10"', '"ndcg@10_binary"', "mrr", '"p@5"', '"p@10"', "topk_female_share_minus_half", "exposure_female_share_minus_half", "frac_nonempty",
       "abs_gap_norm_changed", "signed_gap_norm_changed", "abs_rank_shift_changed", "abs_gap_norm_changed_nonempty"]
sql_view("tidy_in", ("pp",), " UNION ALL ".join("SELECT scorer, split, condition, jd_id, '{}' AS metric, {}::double AS v FROM pp".format(c.strip('"'), c) for c in [*_SM, "n_changed"]))
SUMMARY_SQL = f""", src AS (SELECT * FROM tidy_in WHERE metric <> 'n_changed'), {_boot_sql('src', 'scorer, split, condition, metric')},
 tidy AS (SELECT scorer, split, condition, metric, value, n_units, ci_low, ci_high FROM ci JOIN means USING (scorer, split, condition, metric)
 UNION ALL SELECT scorer, split, condition, metric, sum(v), count(v), NULL, NULL FROM tidy_in WHERE metric = 'n_changed' AND v IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def tidy(t):
    return J.summarise_metrics(t.once("per-pool", lambda: per_pool(t)), n_boot=N_BOOT, seed=SEED)


@query("summarise_metrics", V("tidy_in", SUMMARY_SQL + """ SELECT scorer, split, condition, metric, round(value, 6) AS value, n_units, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM tidy"""))
def _(t):
    return tidy(t).select("scorer", "split", "condition", "metric", r6("value"), "n_units", r6("ci_low"), r6("ci_high"))


def tests(t):
    return J.significance_table(t.once("per-pool", lambda: per_pool(t)).where("split = 'test'"), "a", FAMILIES, n_perm=N_PERM, seed=SEED)


@query("significance_table", V("sig", "SELECT condition, metric, baseline, round(mean_diff, 6) AS mean_diff, round(p_value, 6) AS p_value, n_units, round(p_holm, 6) AS p_holm FROM sig"))
def _(t):
    return tests(t).select("condition", "metric", "baseline", r6("mean_diff"), r6("p_value"), "n_units", r6("p_holm"))


@query("seed_mean_sd", V("sl", """SELECT scorer, split, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sd, count(f) AS n_runs FROM
 (SELECT scorer, split, jd_occupation AS seed, avg(rel_binary * (score > 10)::int) AS f FROM sl GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(t):
    runs = t.scores_long().groupBy("scorer", "split", F.col("jd_occupation").alias("seed")).agg(F.avg(F.col("rel_binary") * (F.col("score") > 10).cast("int")).alias("f"))
    return J.seed_mean_sd(runs, ["scorer", "split"], "f").select("scorer", "split", r6("mean"), r6("sd"), "n_runs")


_Q101 = [i / 100 for i in range(101)]


@query("calibration_quantiles", V("sl", f""", g AS (SELECT scorer, 'all' AS grp, score FROM sl WHERE split = 'dev' UNION ALL SELECT scorer, ['irrelevant', 'related', 'relevant'][rel_graded + 1], score FROM sl WHERE split = 'dev')
 SELECT scorer, grp, array_to_string(list_transform(quantile_cont(score, {_Q101}), lambda x: printf('%.3f', x)), ',') AS quantiles, round(avg(score), 6) AS mean, count(*) AS n FROM g GROUP BY 1, 2"""))
def _(t):
    d = J.calibration_quantiles(t.scores_long().where("split = 'dev'"), ["scorer"])
    return d.select("scorer", "grp", F.expr("array_join(transform(quantiles, x -> format_string('%.3f', x)), ',')").alias("quantiles"), r6("mean"), "n")


@query("pool_sd_median", V("gaps", "SELECT scorer, round(median(pool_sd), 6) AS pool_sd_median, count(*) AS n_pools FROM (SELECT scorer, jd_id, min(pool_sd) AS pool_sd FROM gaps WHERE split = 'dev' GROUP BY 1, 2) GROUP BY 1"))
def _(t):
    d = t.audited().where("split = 'dev'").groupBy(*POOL, "condition").agg(F.stddev_samp("score").alias("pool_sd"))
    return J.pool_sd_median(d).select("scorer", r6("pool_sd_median"), "n_pools")


@query("percentile_of", V("sl", f""", q AS (SELECT scorer, quantile_cont(score, {_Q101}) AS q FROM sl WHERE split = 'dev' GROUP BY 1),
 v AS (SELECT DISTINCT scorer, score + 0.25 AS v FROM sl WHERE split = 'test'), b AS (SELECT scorer, v, q, len(list_filter(q, lambda x: x <= v)) AS k FROM v JOIN q USING (scorer))
 SELECT scorer, v, round(CASE WHEN v <= q[1] THEN 0 WHEN v >= q[101] THEN 100 ELSE (k - 1) + CASE WHEN q[k + 1] = q[k] THEN 0 ELSE (v - q[k]) / (q[k + 1] - q[k]) END END, 6) AS percentile FROM b"""))
def _(t):
    cal = J.calibration_quantiles(t.scores_long().where("split = 'dev'"), ["scorer"]).where("grp = 'all'").select("scorer", "quantiles")
    v = t.scores_long().where("split = 'test'").select("scorer", (F.col("score") + 0.25).alias("v")).distinct()
    return v.join(cal, "scorer").select("scorer", "v", r6(J.percentile_of(F.col("v"), F.col("quantiles")), "percentile"))


@query("held_out_groups", V("pp", f""", src AS (SELECT scorer, jd_id, "ndcg@10" AS v FROM pp WHERE condition = 'original' AND split = 'test' AND jd_id % 4 <> 1), {_boot_sql('src', 'scorer')}
 SELECT scorer, round(value, 6) AS value, n_units, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(value_all, 6) AS value_all FROM ci JOIN means USING (scorer)
 JOIN (SELECT scorer, avg("ndcg@10") AS value_all FROM pp WHERE condition = 'original' AND split = 'test' GROUP BY 1) USING (scorer)"""))
def _(t):
    m = written(ranking_metrics(t).where("split = 'test'").select("scorer", "jd_id", r6("ndcg@10")), "units")
    seen = t.scored().where("jd_id % 4 = 1").select("jd_id").distinct()
    d = J.held_out_groups(m, seen, ["scorer"], "ndcg@10", n_boot=N_BOOT, seed=SEED)
    return d.select("scorer", r6("value"), "n_units", r6("ci_low"), r6("ci_high"), r6("value_all"))


@query("select_variant", V("rm", """, v AS (SELECT scorer, CASE scorer WHEN 'a' THEN 3 WHEN 'b' THEN 1 ELSE 2 END AS n_components, round(avg(ndcg), 6) AS m FROM rm WHERE split = 'dev' GROUP BY 1)
 SELECT scorer, n_components, m AS dev_ndcg FROM v WHERE m >= (SELECT max(m) FROM v) - 0.05 ORDER BY n_components, scorer LIMIT 1"""))
def _(t):
    v = ranking_metrics(t).where("split = 'dev'").groupBy("scorer").agg(r6(F.avg("`ndcg@10`"), "dev_ndcg"))
    v = v.withColumn("n_components", F.expr("CASE scorer WHEN 'a' THEN 3 WHEN 'b' THEN 1 ELSE 2 END"))
    return J.select_variant(v, "dev_ndcg", ["n_components", "scorer"], 0.05)


@query("quantiles", V("sl", f"""SELECT scorer, jd_id, p, round(q, 6) AS q FROM (SELECT scorer, jd_id, unnest([0.1, 0.5, 0.9]) AS p, unnest(quantile_cont(score, [0.1, 0.5, 0.9])) AS q FROM sl GROUP BY 1, 2)"""))
def _(t):
    return quantiles(t.scores_long(), ["scorer", "jd_id"], "score", [0.1, 0.5, 0.9]).select("scorer", "jd_id", "p", r6("q"))
