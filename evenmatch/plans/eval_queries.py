"""Span evaluation, near misses, annotation and wording as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..operators import annotation as A, nearmiss as N, span_eval as K, wording
from ..sources.readers import read_concept_edges
from ..sources.rules import ENDINGS, FEMININE_CODED, MASCULINE_CODED
from .audit_queries import N_BOOT, SEED, r6
from .catalog import query
from .data_queries import edges_path
from .views import sql_view, with_views as V

# ------------------------------------------------------------------------------ span evaluation
_OV = '{a}.doc_id = {b}.doc_id AND {a}.start < {b}."end" AND {b}.start < {a}."end"'
OV = _OV.format(a="p", b="g")
EQ = 'p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end"'


@query("span_exact_counts", V("pred gold", f"""SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, count(p.doc_id) AS n_pred, count(g.doc_id) AS n_gold, count_if(p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS n_hit
 FROM pred p FULL JOIN gold g ON {EQ} GROUP BY 1"""))
def _(t):
    return K.span_exact_counts(t.word_spans(7), t.word_spans(6))


@query("span_partial_counts", V("pred gold", f"""SELECT p.doc_id, count(DISTINCT (p.start, p."end")) AS n_pred_correct, count(DISTINCT (g.start, g."end")) AS n_gold_found FROM pred p JOIN gold g ON {OV} GROUP BY 1"""))
def _(t):
    return K.span_partial_counts(t.word_spans(7), t.word_spans(6))


sql_view("vp", ("pred",), "SELECT *, unnest(CASE label WHEN 'skill' THEN ['all', 'skill'] ELSE ['all', 'knowledge'] END) AS view FROM pred")
sql_view("vg", ("gold",), "SELECT *, unnest(CASE label WHEN 'skill' THEN ['all', 'skill'] ELSE ['all', 'knowledge'] END) AS view FROM gold")
sql_view("prf", ("vp", "vg"), f"""SELECT source, view, sum(np) AS np, sum(ng) AS ng, sum(ex) AS ex, sum(pc) AS pc, sum(gf) AS gf FROM (
  SELECT source, view, 1 AS np, 0 AS ng, (EXISTS (SELECT 1 FROM vg g WHERE g.view = p.view AND {EQ}))::int AS ex, (EXISTS (SELECT 1 FROM vg g WHERE g.view = p.view AND {OV}))::int AS pc, 0 AS gf FROM vp p
  UNION ALL SELECT source, view, 0, 1, 0, 0, (EXISTS (SELECT 1 FROM vp p WHERE g.view = p.view AND {OV}))::int FROM vg g) GROUP BY GROUPING SETS ((view), (source, view))""")


@query("span_prf", V("prf", """, m AS (SELECT coalesce(source, 'all') AS "group", view, 'exact' AS mode, CASE WHEN np > 0 THEN ex / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN ex / ng ELSE 0 END AS r, np, ng FROM prf
 UNION ALL SELECT coalesce(source, 'all'), view, 'partial', CASE WHEN np > 0 THEN pc / np ELSE 0 END, CASE WHEN ng > 0 THEN gf / ng ELSE 0 END, np, ng FROM prf)
 SELECT "group", view, mode, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, np::bigint AS n_pred, ng::bigint AS n_gold FROM m"""))
def _(t):
    d = K.span_prf(t.word_spans(7), t.word_spans(6))
    return d.select("group", "view", "mode", r6("precision"), r6("recall"), r6("f1"), "n_pred", "n_gold")


@query("span_errors", V("pred gold", f""", wrong AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE {EQ})),
 t AS (SELECT g.doc_id, g.start, g."end", any_value(g.text) AS text, string_agg(p.text, ' | ' ORDER BY p.start, p."end") AS preds FROM wrong g LEFT JOIN pred p ON {OV} GROUP BY 1, 2, 3),
 e AS (SELECT 'false_positive' AS kind, lower(p.text) AS text FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE {OV}) UNION ALL
  SELECT 'boundary', text || '  ->  ' || preds FROM t WHERE preds IS NOT NULL UNION ALL SELECT 'missed', lower(text) FROM t WHERE preds IS NULL)
 SELECT kind, text, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, text) AS rn FROM (SELECT kind, text, count(*) AS n FROM e GROUP BY 1, 2)) WHERE rn <= 40"""))
def _(t):
    return K.span_errors(t.word_spans(7), t.word_spans(6))


@query("unannotated_share", V("pred gold", "SELECT count(*) AS n_pred, count_if(doc_id NOT IN (SELECT doc_id FROM gold WHERE label = 'knowledge')) AS n_unannotated FROM pred"))
def _(t):
    return K.unannotated_share(t.word_spans(7), t.word_spans(6).where("label = 'knowledge'"))


@query("span_examples", V("pred gold", """, a AS (SELECT doc_id, string_agg('[' || text || ']/' || upper(label[1]), ', ' ORDER BY start) AS gold FROM gold GROUP BY 1),
 b AS (SELECT doc_id, string_agg('[' || text || ']/' || upper(label[1]), ', ' ORDER BY start) AS pred FROM pred GROUP BY 1)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sha256(coalesce(gold, '-')) AS gold, sha256(coalesce(pred, '-')) AS pred FROM a FULL JOIN b ON a.doc_id = b.doc_id"""))
def _(t):
    return K.span_examples(t.word_spans(7), t.word_spans(6)).select("doc_id", F.sha2("gold", 256).alias("gold"), F.sha2("pred", 256).alias("pred"))


# ---------------------------------------------------------------------------------- near misses
sql_view("cent", ("ent",), "SELECT bag, side, concept, arg_min(embedding, pos) AS embedding, min(pos) AS pos FROM ent GROUP BY 1, 2, 3")
sql_view("cm", ("cent", "bag_pairs"), """SELECT * EXCLUDE (rn) FROM (SELECT p.jd_id, p.bio_id, j.concept AS jd_concept, r.concept AS bio_concept,
  round(list_sum(list_transform(list_zip(j.embedding, r.embedding), lambda z: z[1]::double * z[2]::double)), 6) AS sim, row_number() OVER (PARTITION BY p.jd_id, p.bio_id, j.concept ORDER BY
  list_sum(list_transform(list_zip(j.embedding, r.embedding), lambda z: z[1]::double * z[2]::double)) DESC, r.pos) AS rn
  FROM bag_pairs p JOIN cent j ON j.bag = p.jd_id JOIN cent r ON r.bag = p.bio_id) WHERE rn = 1""")
sql_view("cr_", ("cm", "edges"), """SELECT m.*, CASE WHEN jd_id % 10 < 3 THEN 'dev' ELSE 'test' END AS split,
  jd_concept = bio_concept OR EXISTS (SELECT 1 FROM edges e WHERE (e."conceptUri" = jd_concept AND e."broaderUri" = bio_concept) OR (e."conceptUri" = bio_concept AND e."broaderUri" = jd_concept)) AS strict,
  EXISTS (SELECT 1 FROM edges a JOIN edges b ON a."broaderUri" = b."broaderUri" WHERE a."conceptUri" = jd_concept AND b."conceptUri" = bio_concept) AS sibling FROM cm m""")
sql_view("rel", ("cr_",), "SELECT * EXCLUDE (sibling), strict OR sibling AS lenient FROM cr_")
LOS, HIS = N.grid(-0.1, 0.3, 0.05), N.grid(-0.05, 0.5, 0.05)
sql_view("bands", ("rel",), f"""SELECT s.split, lo, hi, count(sim) AS n, avg(strict::int) AS strict, avg(lenient::int) AS lenient, count(sim) / any_value(np) AS per_pair FROM
  (SELECT split, count(DISTINCT (jd_id, bio_id)) AS np FROM rel GROUP BY 1) s, (SELECT unnest({LOS}::double[]) AS lo) a, (SELECT unnest({HIS}::double[]) AS hi) b
  LEFT JOIN rel ON rel.split = s.split AND sim >= lo AND sim < hi WHERE hi > lo GROUP BY 1, 2, 3""")


def concept_matches(t):
    e = t.entities()
    jd = N.concept_bags(e.where("side = 'jd'").withColumnRenamed("bag", "jd_id"), "jd_id")
    bio = N.concept_bags(e.where("side = 'bio'").withColumnRenamed("bag", "bio_id"), "bio_id")
    return N.best_concept_match(t.bag_pairs(), jd, bio).withColumn("sim", F.round("sim", 6))


def related(t):
    d = N.concept_related(concept_matches(t), read_concept_edges(t.spark, edges_path(t)))
    return d.withColumn("split", F.expr("CASE WHEN jd_id % 10 < 3 THEN 'dev' ELSE 'test' END"))


@query("best_concept_match", V("cm", "SELECT * FROM cm"))
def _(t):
    return concept_matches(t)


@query("concept_related", V("rel", "SELECT jd_id, bio_id, jd_concept, bio_concept, strict, lenient FROM rel"))
def _(t):
    return related(t).select("jd_id", "bio_id", "jd_concept", "bio_concept", "strict", "lenient")


@query("band_grid", V("bands", "SELECT split, lo, hi, n, round(strict, 6) AS strict, round(lenient, 6) AS lenient, round(per_pair, 6) AS per_pair FROM bands"))
def _(t):
    return N.band_grid(related(t), LOS, HIS, ["split"]).select("split", "lo", "hi", "n", r6("strict"), r6("lenient"), r6("per_pair"))


_BANDS = [(-0.05, 0.1), (0.0, 0.2), (0.1, 0.4)]


@query("band_ci", V("rel", f""", src AS (SELECT split, lo, hi, kind, jd_id, sum(v)::double AS num, count(*)::double AS den FROM (
  SELECT split, lo, hi, jd_id, 'strict' AS kind, strict::int AS v FROM rel, (VALUES {', '.join(f'({a}::double, {b}::double)' for a, b in _BANDS)}) x(lo, hi) WHERE sim >= lo AND sim < hi
  UNION ALL SELECT split, lo, hi, jd_id, 'lenient', lenient::int FROM rel, (VALUES {', '.join(f'({a}::double, {b}::double)' for a, b in _BANDS)}) x(lo, hi) WHERE sim >= lo AND sim < hi) GROUP BY 1, 2, 3, 4, 5),
 u AS (SELECT *, row_number() OVER (PARTITION BY split, lo, hi, kind ORDER BY sha256('{SEED}|' || jd_id::varchar)) - 1 AS idx, count(*) OVER (PARTITION BY split, lo, hi, kind) AS n FROM src),
 d AS (SELECT s.* EXCLUDE (n), b, {draw_sql('b', 'i', 'n', SEED)} AS idx FROM (SELECT DISTINCT split, lo, hi, kind, n FROM u) s, range(1, {N_BOOT + 1}) AS x(b), LATERAL (SELECT unnest(range(n)) AS i) y),
 r AS (SELECT split, lo, hi, kind, b, sum(num) / sum(den) AS r FROM d JOIN u USING (split, lo, hi, kind, idx) GROUP BY 1, 2, 3, 4, 5),
 p AS (SELECT split, lo, hi, kind, sum(num) / sum(den) AS value, count(*) AS n_units FROM src GROUP BY 1, 2, 3, 4)
 SELECT split, lo, hi, kind, round(any_value(value), 6) AS value, any_value(n_units) AS n_units, round(quantile_cont(r, 0.025), 6) AS ci_low, round(quantile_cont(r, 0.975), 6) AS ci_high FROM p JOIN r USING (split, lo, hi, kind) GROUP BY 1, 2, 3, 4"""))
def _(t):
    d = N.band_ci(related(t), _BANDS, ["split"], N_BOOT, SEED)
    return d.select("split", "lo", "hi", "kind", r6("value"), "n_units", r6("ci_low"), r6("ci_high"))


@query("choose_band", V("bands", "SELECT lo, hi, n, round(lenient, 6) AS lenient FROM bands WHERE split = 'dev' AND n >= 30 ORDER BY bands.lenient DESC, n DESC, lo, hi LIMIT 1"))
def _(t):
    b = N.band_grid(related(t).where("split = 'dev'"), LOS, HIS)
    return N.choose_band(b, 30).select("lo", "hi", "n", r6("lenient"))


@query("suggestions", V("cm", """SELECT jd_id, bio_id, row_number() OVER (PARTITION BY jd_id, bio_id ORDER BY sim DESC, jd_concept, bio_concept) AS rank, jd_concept, bio_concept, sim FROM cm WHERE sim >= 0.05 AND sim < 0.25"""))
def _(t):
    return N.suggestions(concept_matches(t), 0.05, 0.25)


@query("base_rates", V("rel", "SELECT split, round(avg(strict::int), 6) AS strict, round(avg(lenient::int), 6) AS lenient, count(*) AS n FROM rel GROUP BY 1"))
def _(t):
    return N.base_rates(related(t), ["split"]).select("split", r6("strict"), r6("lenient"), "n")


# ----------------------------------------------------------------------------------- annotation
sql_view("cons", ("sl",), """SELECT jd_id, bio_id, any_value(split) AS split, any_value(jd_occupation) AS jd_occupation, any_value(bio_gender) AS bio_gender, any_value(rel_graded) AS rel_graded, round(avg(pct), 9) AS consensus FROM (
  SELECT *, (rank() OVER (PARTITION BY scorer, jd_id ORDER BY score) + (count(*) OVER (PARTITION BY scorer, jd_id, score) - 1) / 2) / count(*) OVER (PARTITION BY scorer, jd_id) AS pct FROM sl) GROUP BY 1, 2""")
sql_view("binned", ("cons",), """SELECT *, (consensus > (SELECT quantile_cont(consensus, 0.5) FROM cons WHERE split = 'test'))::int + (consensus > (SELECT quantile_cont(consensus, 0.9) FROM cons WHERE split = 'test'))::int AS score_bin
  FROM cons WHERE split = 'test'""")
sql_view("strata", ("binned",), "SELECT score_bin, jd_occupation, bio_gender, count(*) AS size FROM binned GROUP BY 1, 2, 3")
sql_view("alloc", ("strata",), """SELECT * EXCLUDE (one, rest, cap, q, x, lft), one + x + CASE WHEN x < cap AND row_number() OVER (PARTITION BY score_bin, x < cap ORDER BY round(q - floor(q), 9) DESC, size DESC, jd_occupation, bio_gender) <= lft THEN 1 ELSE 0 END AS alloc FROM (
  SELECT *, greatest(0, rest - sum(x) OVER (PARTITION BY score_bin)) AS lft FROM (SELECT *, least(floor(q)::bigint, cap) AS x FROM (SELECT *, coalesce(cap / nullif(sum(cap) OVER (PARTITION BY score_bin), 0) * rest, 0) AS q FROM (
  SELECT *, size - one AS cap, greatest(0, 40 - sum(one) OVER (PARTITION BY score_bin)) AS rest FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY score_bin ORDER BY size DESC, jd_occupation, bio_gender) <= 40 THEN 1 ELSE 0 END AS one FROM strata)))))""")
sql_view("samp", ("binned", "alloc"), """SELECT *, printf('p%03d', row_number() OVER (ORDER BY sha256('24|' || jd_id::varchar || '|' || bio_id::varchar)) - 1) AS pair_id FROM (
  SELECT b.*, row_number() OVER (PARTITION BY score_bin, jd_occupation, bio_gender ORDER BY sha256('23|' || jd_id::varchar || '|' || bio_id::varchar)) AS rn, a.alloc FROM binned b JOIN alloc a USING (score_bin, jd_occupation, bio_gender)) WHERE rn <= alloc""")


def consensus(t):
    long = t.scores_long()
    c = A.consensus_scores(long, ["a", "b", "c"]).withColumn("consensus", F.round("consensus", 9))
    meta = t.scored().select("jd_id", "bio_id", "split", "jd_occupation", "bio_gender", "rel_graded")
    return c.join(meta.hint("merge"), ["jd_id", "bio_id"])  # a pair per row, however small its files


def binned(t):
    return A.score_bins(t.once("consensus", lambda: consensus(t)).where("split = 'test'"))


STRATA = ["score_bin", "jd_occupation", "bio_gender"]


def allocation(frame):
    sizes = frame.groupBy(*STRATA).agg(F.count(F.lit(1)).alias("size"))
    return A.allocate_sample(sizes, STRATA[1:], 40, ["score_bin"])


def sample(t):
    frame = t.once("binned", lambda: binned(t))
    return A.stratified_sample(frame, STRATA, allocation(frame), 23, ["jd_id", "bio_id"])


@query("consensus_scores", V("cons", "SELECT jd_id, bio_id, consensus FROM cons"))
def _(t):
    return consensus(t).select("jd_id", "bio_id", "consensus")


@query("score_bins", V("binned", "SELECT score_bin, count(*) AS n_pairs, min(consensus) AS lowest, max(consensus) AS highest FROM binned GROUP BY 1"))
def _(t):
    return binned(t).groupBy("score_bin").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("consensus").alias("lowest"), F.max("consensus").alias("highest"))


@query("allocate_sample", V("alloc", "SELECT score_bin, jd_occupation, bio_gender, size, alloc::bigint AS alloc FROM alloc"))
def _(t):
    return allocation(binned(t))


@query("stratified_sample", V("samp", "SELECT pair_id, jd_id, bio_id, score_bin FROM samp"))
def _(t):
    return sample(t).select("pair_id", "jd_id", "bio_id", "score_bin")


@query("blind_split", V("samp", """SELECT s.pair_id, sha256(b.text) AS jd_hash, sha256(d.text) AS bio_hash, s.rel_graded, s.consensus FROM samp s JOIN benchmark b ON b.item_id = s.jd_id % 40 JOIN documents d ON d.doc_id = s.bio_id % 1000"""))
def _(t):
    s = sample(t)
    jds = t.scored().select("jd_id").distinct().withColumn("item_id", F.col("jd_id") % 40).join(t.read("benchmark"), "item_id").select("jd_id", "text")
    bios = s.select("bio_id").distinct().withColumn("doc_id", F.col("bio_id") % 1000).join(t.read("documents"), "doc_id").select("bio_id", "text")
    visible, meta = A.blind_split(s, jds, bios)
    return visible.join(meta, "pair_id").select("pair_id", F.sha2("jd_text", 256).alias("jd_hash"), F.sha2("bio_text", 256).alias("bio_hash"), "rel_graded", "consensus")


def latest(t):
    return A.latest_ratings(t.ratings(), order=("ts", "event_id"))


ANNOTATORS = ["a0", "a1", "a2"]


@query("latest_ratings", V("lat", "SELECT * FROM lat"))
def _(t):
    return latest(t)


@query("ratings_wide", V("lat", """SELECT pair_id, max(rating) FILTER (annotator = 'a0') AS a0, max(rating) FILTER (annotator = 'a1') AS a1, max(rating) FILTER (annotator = 'a2') AS a2 FROM lat GROUP BY 1"""))
def _(t):
    return A.ratings_wide(latest(t), ANNOTATORS)


@query("pairwise_kappa", V("lat", """, j AS (SELECT x.annotator AS a, y.annotator AS b, x.rating AS ra, y.rating AS rb FROM lat x JOIN lat y ON x.pair_id = y.pair_id AND x.annotator < y.annotator),
 c AS (SELECT a, b, ra, rb, count(*) AS c FROM j GROUP BY 1, 2, 3, 4),
 e AS (SELECT x.a, x.b, sum(x.c * y.c * (x.ra <> y.rb)::int) AS e1, sum(x.c * y.c * (x.ra - y.rb) ** 2) AS e2 FROM c x JOIN c y ON x.a = y.a AND x.b = y.b GROUP BY 1, 2)
 SELECT c.a, c.b, sum(c)::bigint AS n, round(1 - sum(c * (ra <> rb)::int) * sum(c) / any_value(e1), 6) AS kappa, round(1 - sum(c * (ra - rb) ** 2) * sum(c) / any_value(e2), 6) AS kappa_quadratic FROM c JOIN e ON c.a = e.a AND c.b = e.b GROUP BY 1, 2"""))
def _(t):
    return A.pairwise_kappa(latest(t)).select("a", "b", "n", r6("kappa"), r6("kappa_quadratic"))


@query("krippendorff_ordinal", V("lat", """, n AS (SELECT pair_id, rating, count(*) AS c, sum(count(*)) OVER (PARTITION BY pair_id) AS m FROM lat GROUP BY 1, 2),
 o AS (SELECT a.rating AS r1, b.rating AS r2, sum(a.c * (b.c - (a.rating = b.rating)::int) / (a.m - 1)) AS o FROM n a JOIN n b USING (pair_id) WHERE a.m >= 2 GROUP BY 1, 2),
 nc AS (SELECT r1 AS r, sum(o) AS nc FROM o GROUP BY 1),
 d AS (SELECT x.r AS r1, y.r AS r2, x.nc * y.nc AS e, CASE WHEN x.r = y.r THEN 0 ELSE ((SELECT sum(nc) FROM nc g WHERE g.r BETWEEN least(x.r, y.r) AND greatest(x.r, y.r)) - (x.nc + y.nc) / 2) ** 2 END AS d FROM nc x, nc y)
 SELECT round(1 - ((SELECT sum(nc) FROM nc) - 1) * sum(coalesce(o.o, 0) * d.d) / sum(e * d), 6) AS alpha, (SELECT count(DISTINCT pair_id) FROM n WHERE m >= 2) AS n_units, round((SELECT sum(nc) FROM nc), 6) AS n_values
 FROM d LEFT JOIN o ON o.r1 = d.r1 AND o.r2 = d.r2"""))
def _(t):
    return A.krippendorff_ordinal(latest(t)).select(r6("alpha"), "n_units", r6("n_values"))


# each rated pair stands for the candidates of one residue class
sql_view("rated", ("lat", "sl"), """SELECT h.pair_id, h.human_mean, s.scorer, s.score, s.rel_graded FROM (SELECT pair_id, avg(rating) AS human_mean FROM lat GROUP BY 1) h JOIN
  (SELECT bio_id % 300 AS pair_id, scorer, round(avg(score), 6) AS score, (sum(rel_graded) % 3)::bigint AS rel_graded FROM sl GROUP BY 1, 2) s USING (pair_id)""")


def rated(t):
    h = latest(t).groupBy("pair_id").agg(F.avg("rating").alias("human_mean"))
    s = t.scores_long().groupBy((F.col("bio_id") % 300).alias("pair_id"), "scorer").agg(
        F.round(F.avg("score"), 6).alias("score"), (F.sum("rel_graded") % 3).alias("rel_graded"))
    return h.join(s, "pair_id")


_AVG_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2)"
SPEARMAN_SQL = f""", k AS (SELECT scorer, {_AVG_RANK.format(k='scorer', c='score')} AS rx, {_AVG_RANK.format(k='scorer', c='human_mean')} AS ry FROM rated),
 u AS (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY sha256('{SEED}|' || pair_id::varchar)) - 1 AS idx, count(*) OVER (PARTITION BY scorer) AS n FROM rated),
 d AS (SELECT s.scorer, b, {draw_sql('b', 'i', 'n', SEED)} AS idx FROM (SELECT DISTINCT scorer, n FROM u) s, range(1, 201) AS x(b), LATERAL (SELECT unnest(range(n)) AS i) y),
 v AS (SELECT scorer, b, score, human_mean FROM d JOIN u USING (scorer, idx)),
 w AS (SELECT scorer, b, {_AVG_RANK.format(k='scorer, b', c='score')} AS rx, {_AVG_RANK.format(k='scorer, b', c='human_mean')} AS ry FROM v),
 r AS (SELECT scorer, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM (SELECT scorer, b, corr(rx, ry) AS rho FROM w GROUP BY 1, 2) GROUP BY 1)
 SELECT k.scorer, round(corr(rx, ry), 6) AS rho, count(*) AS n, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM k JOIN r USING (scorer) GROUP BY 1"""


@query("spearman_ci", V("rated", SPEARMAN_SQL))
def _(t):
    d = A.spearman_ci(rated(t), "score", "human_mean", "pair_id", ["scorer"], 200, 0.05, SEED)
    return d.select("scorer", r6("rho"), "n", r6("ci_low"), r6("ci_high"))


@query("label_validity", V("rated", f""", one AS (SELECT DISTINCT pair_id, human_mean, rel_graded FROM rated), k AS (SELECT {_AVG_RANK.format(k='true', c='human_mean')} AS rx, {_AVG_RANK.format(k='true', c='rel_graded')} AS ry FROM one)
 SELECT rel_graded, count(*) AS n_pairs, round(avg(human_mean), 6) AS mean_rating, round((SELECT CASE WHEN stddev_pop(ry) > 0 THEN corr(rx, ry) END FROM k), 6) AS rho FROM one GROUP BY 1"""))
def _(t):
    one = t.once("rated-pairs", lambda: rated(t).select("pair_id", "human_mean", "rel_graded").distinct())
    rho = A.spearman(one, "human_mean", "rel_graded").select("rho").scalar()
    return A.label_means(one).select("rel_graded", "n_pairs", r6("mean_rating"), r6(rho, "rho"))


@query("scorer_validity", V("rated", SPEARMAN_SQL.replace(" SELECT k.scorer, round(corr", ", z AS (SELECT k.scorer, round(corr") + ") SELECT *, row_number() OVER (ORDER BY rho DESC NULLS LAST, scorer) AS place FROM z"))
def _(t):
    """Every scorer against the mean human rating, best first."""
    d = A.spearman_ci(rated(t), "score", "human_mean", "pair_id", ["scorer"], 200, 0.05, SEED)
    d = d.select("scorer", r6("rho"), "n", r6("ci_low"), r6("ci_high"))
    return A.by_rho(d)


@query("annotator_order", V("v6", """SELECT annotator, pair_id, row_number() OVER (PARTITION BY annotator ORDER BY sha256('order|' || annotator || '|' || pair_id::varchar)) - 1 AS position
 FROM (SELECT DISTINCT 'priya_a_' || annotator[2] AS annotator FROM v6), (SELECT DISTINCT pair_id FROM v6)"""))
def _(t):
    names = t.ratings().select(F.concat(F.lit("  Priya A. "), F.substring("annotator", 2, 1)).alias("name")).distinct()
    return A.annotator_order(t.ratings().select("pair_id").distinct(), names.select(A.annotator_slug(F.col("name")).alias("annotator")))


@query("annotation_progress", V("lat", """SELECT annotator, count(*) AS rated, (SELECT count(DISTINCT event_id % 450) FROM events) - count(*) AS remaining FROM lat GROUP BY 1"""))
def _(t):
    return A.annotation_progress(latest(t), t.read("events").select((F.col("event_id") % 450).alias("pair_id")))


# -------------------------------------------------------------------------------------- wording
sql_view("wforms", (), f"""SELECT word, type, arg_min(entry, ord) AS matched FROM (SELECT entry, type, ord, regexp_replace(entry, 'e$', '') || ending AS word FROM (
  SELECT unnest({list(MASCULINE_CODED)}) AS entry, 'masculine-coded' AS type, unnest(range({len(MASCULINE_CODED)})) AS ord UNION ALL
  SELECT unnest({list(FEMININE_CODED)}), 'feminine-coded', unnest(range({len(FEMININE_CODED)}))), (SELECT unnest({list(ENDINGS)}) AS ending)) GROUP BY 1, 2""")
# the invented texts hold few coded words, so each gets one that depends on its id
_CODED = ("lead", "supporting", "warmup", "independently", "commitment", "self-reliant", "kindly", "objectives")
_ADD = "(ARRAY[" + ", ".join(f"'{w}'" for w in _CODED) + "])"
sql_view("wdocs", ("v1",), f"SELECT bio_id, text || ' ' || {_ADD}[1 + (bio_id % 8)::int] AS text FROM v1")
sql_view("wtok", ("wdocs",), """SELECT bio_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT bio_id, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*') AS l FROM wdocs)""")
sql_view("wscore", ("wdocs", "wtok", "wforms"), """SELECT *, CASE WHEN m = 0 AND f = 0 THEN 'No gender-coded words found' WHEN abs(score) < 1 THEN 'Roughly balanced: masculine- and feminine-coded words appear at similar rates'
  WHEN score > 0 THEN 'Leans masculine-coded: may discourage some applicants' ELSE 'Leans feminine-coded: may discourage some applicants' END AS verdict FROM (
  SELECT bio_id, n_words, m, f, round_even((m - f) / greatest(n_words, 1) * 100, 2) AS score FROM (SELECT d.bio_id, len(regexp_extract_all(lower(any_value(d.text)), '[a-z]+(?:-[a-z]+)*')) AS n_words,
  coalesce(count_if(x.type = 'masculine-coded'), 0) AS m, coalesce(count_if(x.type = 'feminine-coded'), 0) AS f FROM wdocs d LEFT JOIN (SELECT bio_id, type FROM wtok JOIN wforms USING (word)) x USING (bio_id) GROUP BY 1))""")


def coded_texts(t):
    return t.v1().select("bio_id", F.concat("text", F.lit(" "), F.get(F.array(*[F.lit(w) for w in _CODED]), (F.col("bio_id") % 8).cast("int"))).alias("text"))


@query("flag_coded_words", V("wtok wforms", "SELECT bio_id, pos, word, type, matched FROM wtok JOIN wforms USING (word)"))
def _(t):
    return wording.flag_coded_words(coded_texts(t), wording.form_table(t.spark))


@query("wording_score", V("wscore", "SELECT bio_id, n_words, m AS masculine_count, f AS feminine_count, score, verdict FROM wscore"))
def _(t):
    return wording.wording_score(coded_texts(t), wording.form_table(t.spark))
