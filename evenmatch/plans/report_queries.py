"""Report tables as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E, nearmiss as N, reports as O, resampling as J
from ..sources import writers
from ..sources.storage import shared_dir, written
from .audit_queries import SUMMARY_SQL, r6, tests, tidy
from .catalog import query
from .eval_queries import HIS, LOS, related
from .score_queries import jd_entities, target_texts
from .views import with_views as V

_CELL = "CASE WHEN ci_low IS NULL THEN printf('%.3f', value) ELSE printf('%.3f [%.3f, %.3f]', value, ci_low, ci_high) END"
GAP = "abs_gap_norm_changed"


def _rounded(t):
    """The tidy table, written once: reports only read it. Six decimals, so that cells print alike."""
    return written(tidy(t).select("scorer", "split", "condition", "metric", r6("value"), "n_units", r6("ci_low"), r6("ci_high")), "tidy")


_R = SUMMARY_SQL + ", tr AS (SELECT scorer, split, condition, metric, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM tidy)"


@query("metric_pivot", V("tidy_in", _R + f""" SELECT scorer, coalesce(max({_CELL}) FILTER (condition = 'swap'), '-') AS swap, coalesce(max({_CELL}) FILTER (condition = 'noop'), '-') AS noop
 FROM tr WHERE metric = '{GAP}' AND split = 'test' GROUP BY 1"""))
def _(t):
    return O.metric_pivot(_rounded(t), GAP, ["swap", "noop"])


@query("significance_marks", V("tidy_in sig", _R + """ SELECT tr.scorer, tr.condition, tr.metric, tr.value, CASE WHEN sig.p_holm < 0.05 THEN '†' ELSE '' END AS mark FROM tr LEFT JOIN sig ON sig.baseline = tr.scorer AND sig.condition = tr.condition
 AND sig.metric = tr.metric WHERE split = 'test'"""))
def _(t):
    d = O.significance_marks(_rounded(t).where("split = 'test'"), tests(t))
    return d.select("scorer", "condition", "metric", "value", "mark")


@query("ablation_table", V("tidy_in", _R + f""" SELECT scorer, max(value) FILTER (condition = 'original' AND metric = 'ndcg@10') AS accuracy, max(value) FILTER (condition = 'original' AND metric = 'frac_nonempty') AS coverage,
 max(value) FILTER (condition = 'swap' AND metric = '{GAP}') AS gap_swap, CASE scorer WHEN 'a' THEN 'quantity' ELSE 'price' END AS label, scorer = 'a' AS is_reference FROM tr WHERE split = 'test' AND scorer IN ('a', 'b') GROUP BY 1"""))
def _(t):
    return O.ablation_table(_rounded(t), {"a": "quantity", "b": "price"}, "a", "ndcg@10", "frac_nonempty", GAP, ["swap"])


@query("headline_points", V("tidy_in", _R + f""" SELECT x.scorer, x.value AS x, x.ci_low AS x_lo, x.ci_high AS x_hi, y.value AS y, y.ci_low AS y_lo, y.ci_high AS y_hi, CASE x.scorer WHEN 'a' THEN 'lexical' ELSE 'neural' END AS family
 FROM tr x JOIN tr y ON x.scorer = y.scorer WHERE x.split = 'test' AND y.split = 'test' AND x.condition = 'original' AND x.metric = 'ndcg@10' AND y.condition = 'swap' AND y.metric = '{GAP}'"""))
def _(t):
    return O.headline_points(_rounded(t), {"a": "lexical"}, "ndcg@10", "swap", GAP)


@query("dataset_profile", V("v1 pairs", """, p AS (SELECT pool_set, jd_occ, jd_id, count(*) AS n FROM pairs GROUP BY 1, 2, 3)
 SELECT 'rows' AS kind, split AS name, count(*) AS n FROM v1 GROUP BY 2 UNION ALL SELECT 'pools_of_class', jd_occ::varchar, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'pools_of_set', pool_set, count(*) FROM p GROUP BY 2
 UNION ALL SELECT 'pools', 'all', count(*) FROM p UNION ALL SELECT 'pairs', 'all', sum(n)::bigint FROM p"""))
def _(t):
    return O.dataset_profile(t.v1(), t.pairs())


_Q101 = [i / 100 for i in range(101)]


@query("artifact_bundle", V("eidf sl gaps bands", f"""
, g AS (SELECT scorer || '/all' AS l, score FROM sl WHERE split = 'dev' UNION ALL SELECT scorer || '/' || ['irrelevant', 'related', 'relevant'][rel_graded + 1], score FROM sl WHERE split = 'dev'),
 c AS (SELECT l, avg(score) AS mean, count(*) AS n, quantile_cont(score, {_Q101}) AS q FROM g GROUP BY 1),
 b AS (SELECT lo, hi FROM bands WHERE split = 'dev' AND n >= 30 ORDER BY bands.lenient DESC, n DESC, lo, hi LIMIT 1)
SELECT 'idf' AS part, ent_key AS name, round(idf, 6) AS value FROM eidf UNION ALL SELECT 'mean', l, round(mean, 6) FROM c UNION ALL SELECT 'n', l, n::double FROM c
 UNION ALL SELECT 'quantile', l || '/' || (i - 1)::varchar, round(q[i], 6) FROM (SELECT l, q, unnest(range(1, 102)) AS i FROM c)
 UNION ALL SELECT 'pool_sd_median', scorer, round(median(pool_sd), 6) FROM (SELECT scorer, jd_id, min(pool_sd) AS pool_sd FROM gaps WHERE split = 'dev' GROUP BY 1, 2) GROUP BY scorer
 UNION ALL SELECT 'band', 'lo', round(lo, 6) FROM b UNION ALL SELECT 'band', 'hi', round(hi, 6) FROM b"""))
def _(t):
    idf, _ = E.entity_idf(jd_entities(t), target_texts(t))
    dev = t.scores_long().where("split = 'dev'")
    sd = dev.groupBy("scorer", "jd_id").agg(F.stddev_samp("score").alias("pool_sd"))
    band = N.choose_band(N.band_grid(related(t).where("split = 'dev'"), LOS, HIS), 30)
    bundle = O.artifact_bundle(idf, J.calibration_quantiles(dev, ["scorer"]), J.pool_sd_median(sd), band)
    path = shared_dir(t.spark, "bundle")
    writers.write_bundle(bundle, path)
    return t.spark.read.schema(bundle.schema).json(path).select("part", "name", r6("value"))
