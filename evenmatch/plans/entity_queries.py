"""The entity scorer composed from text, as a named query and as a scorer of the audit."""

from __future__ import annotations

import copy

from pyspark.sql import functions as F

from ..functions.draws import mix_sql
from ..operators import spans as S
from ..operators.entity_scorer import EntityScorer
from ..sources.storage import written
from .catalog import query
from .text_queries import _spans_sql, _tokens_sql, patterns
from .views import sql_view, with_views as V

THRESHOLD = 0.55


def entity_scorer(t, aggregation: str = "maxsim_mean") -> EntityScorer:
    """Dictionary entities, the longest of overlapping ones, fitted on all targets."""
    pats = written(patterns(t), "patterns")
    extract = lambda d: S.longest_non_overlapping(S.dictionary_spans(d, pats, "text_hash"), "text_hash")
    return EntityScorer(t.spark, extract, aggregation).fit(t.jds())


def scored_by(scorer: EntityScorer, aggregation: str, threshold: float | None, rows):
    """The rows scored under another aggregation, on the same stores."""
    other = copy.copy(scorer)
    other.aggregation, other.threshold = aggregation, threshold
    return other.score(rows)


# entities of every distinct text: dictionary spans, the greedy choice among overlapping ones, first surface forms
sql_view("etx", ("pairs", "jds", "v1"), """SELECT DISTINCT sha256(text) AS h, text FROM (SELECT text FROM jds UNION ALL SELECT v1.text FROM v1 JOIN (SELECT DISTINCT bio_id FROM pairs) p ON p.bio_id = v1.bio_id)""")
sql_view("ewm", ("etx",), _tokens_sql("etx", "h"))
sql_view("esp", ("ewm", "spats"), _spans_sql("ewm", "h"))
sql_view("esel", ("esp",), """SELECT h, k.s AS start, k.e AS "end" FROM (SELECT h, unnest(list_reduce(list([struct_pack(s := start, e := "end")] ORDER BY start - "end", start),
  lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(a, x) ELSE a END)) AS k FROM (SELECT DISTINCT h, start, "end" FROM esp) GROUP BY h)""")
sql_view("eent", ("esp", "esel"), """SELECT h, lower(trim(text)) AS ent_key, arg_min(trim(text), start) AS entity, min(start) AS pos FROM esp JOIN esel USING (h, start, "end") GROUP BY 1, 2""")
sql_view("evec", ("eent",), f"""SELECT entity, dim, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY entity)), 1e-12) AS v FROM (SELECT entity, m % 64 AS dim, sum(CASE WHEN (m // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::double AS v FROM (
  SELECT entity, {mix_sql('unicode(substr(g, 1, 1))::bigint * 65536 + unicode(substr(g, 2, 1))::bigint', 'unicode(substr(g, 3, 1))::bigint')} AS m FROM (
  SELECT entity, unnest(list_transform(range(1, greatest(length(entity), 1) + 1), lambda i: substr(' ' || lower(entity) || ' ', i, 3))) AS g FROM (SELECT DISTINCT entity FROM eent))) GROUP BY 1, 2)""")
sql_view("epair", ("pairs", "jds", "v1"), "SELECT p.jd_id, p.bio_id, sha256(j.text) AS hj, sha256(b.text) AS hr FROM pairs p JOIN jds j USING (jd_id) JOIN v1 b ON b.bio_id = p.bio_id")
sql_view("esim", ("eent", "evec", "epair"), """SELECT a.entity AS ja, b.entity AS rb, sum(x.v * y.v) AS sim FROM (SELECT DISTINCT a.entity, b.entity AS other FROM (SELECT DISTINCT hj, hr FROM epair) p
  JOIN eent a ON a.h = p.hj JOIN eent b ON b.h = p.hr) q JOIN (SELECT DISTINCT entity FROM eent) a ON a.entity = q.entity JOIN (SELECT DISTINCT entity FROM eent) b ON b.entity = q.other
  JOIN evec x ON x.entity = a.entity JOIN evec y ON y.entity = b.entity AND y.dim = x.dim GROUP BY 1, 2""")
sql_view("ebest", ("eent", "epair", "esim"), """SELECT p.hj, p.hr, a.ent_key, max(coalesce(s.sim, 0)) AS sim FROM (SELECT DISTINCT hj, hr FROM epair) p JOIN eent a ON a.h = p.hj JOIN eent b ON b.h = p.hr
  LEFT JOIN esim s ON s.ja = a.entity AND s.rb = b.entity GROUP BY 1, 2, 3""")
sql_view("ewt", ("eent", "jds"), """SELECT ent_key, ln((n + 1) / (count(*) + 1)) + 1 AS w FROM eent JOIN (SELECT DISTINCT sha256(text) AS h FROM jds) USING (h), (SELECT count(DISTINCT text) AS n FROM jds) GROUP BY ent_key, n""")
sql_view("escore", ("ebest", "ewt"), f"""SELECT hj, hr, avg(sim) AS maxsim_mean, avg((sim >= {THRESHOLD})::int) AS threshold_fraction, sum(w * sim) / sum(w) AS idf_weighted FROM ebest JOIN ewt USING (ent_key) GROUP BY 1, 2""")


@query("entity_scorer", V("epair escore", """SELECT x.aggregation, p.jd_id, p.bio_id, round(coalesce(CASE x.aggregation WHEN 'maxsim_mean' THEN s.maxsim_mean WHEN 'idf_weighted' THEN s.idf_weighted ELSE s.threshold_fraction END, 0), 6) AS score,
 s.hj IS NOT NULL AS nonempty FROM epair p CROSS JOIN (SELECT unnest(['maxsim_mean', 'idf_weighted', 'threshold_fraction']) AS aggregation) x LEFT JOIN escore s ON s.hj = p.hj AND s.hr = p.hr"""))
def _(t):
    """Every pooled pair scored from its texts, in two batches, under three aggregations that share one state."""
    scorer = entity_scorer(t)
    rows = t.pairs().join(t.v1().select("bio_id", F.col("text").alias("resume_text")), "bio_id").select("jd_id", F.col("bio_id").alias("text_id"), "resume_text")
    scorer.learn(rows.where("text_id % 3 = 0").select(F.sha2("resume_text", 256).alias("text_hash"), F.col("resume_text").alias("text")))
    parts = [
        scored_by(scorer, name, limit, rows).withColumn("aggregation", F.lit(name)) for name, limit in (("maxsim_mean", None), ("idf_weighted", None), ("threshold_fraction", THRESHOLD))
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("aggregation", "jd_id", F.col("text_id").alias("bio_id"), F.round("score", 6).alias("score"), "nonempty")


sql_view("ereq", ("epair", "eent", "esim", "ewt"), """SELECT p.jd_id, p.bio_id, a.ent_key AS jd_ent, a.pos AS j_pos, w.w, max(struct_pack(sim := coalesce(s.sim, 0), neg := -b.pos, bio_ent := b.ent_key)) AS m
  FROM epair p JOIN eent a ON a.h = p.hj JOIN eent b ON b.h = p.hr JOIN ewt w ON w.ent_key = a.ent_key LEFT JOIN esim s ON s.ja = a.entity AND s.rb = b.entity GROUP BY ALL""")


@query("entity_report", V("ereq", """SELECT jd_id, bio_id, rank, jd_ent, round(m.sim, 6) AS sim, round(weight, 6) AS weight, round(weight * m.sim, 6) AS contribution FROM (
 SELECT *, row_number() OVER (PARTITION BY jd_id, bio_id ORDER BY w DESC, j_pos) AS rank FROM (SELECT *, w / sum(w) OVER (PARTITION BY jd_id, bio_id) AS weight FROM ereq)) WHERE rank <= 10"""))
def _(t):
    """The ten weightiest requirements of every pooled pair, with their best matches, from the texts."""
    rows = t.pairs().join(t.v1().select("bio_id", F.col("text").alias("resume_text")), "bio_id").select("jd_id", F.col("bio_id").alias("text_id"), "resume_text")
    out = entity_scorer(t).report(rows, 10, "weight")
    return out.select("jd_id", F.col("text_id").alias("bio_id"), "rank", "jd_ent", *[F.round(c, 6).alias(c) for c in ("sim", "weight", "contribution")])
