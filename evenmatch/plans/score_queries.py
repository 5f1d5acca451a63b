"""Lexical, dense and entity scores as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import parse_fit_score
from ..operators import dense, entities as E, lexical as L, pairwise, ranking, search as S
from ..operators.dense import embed_texts
from ..sources.storage import written
from .catalog import query
from .text_queries import STOPS
from .views import sql_view, with_views as V

r6 = lambda c: F.round(c, 6).alias(c)


# ------------------------------------------------------------------------------------ lexical
def corpus(t):
    """All training bios and all target texts."""
    return L.fit_corpus(t.v1().where("split = 'train'"), t.jds())


sql_view("corpus", ("v1", "jds"), """SELECT 't' || bio_id::varchar AS doc, text FROM v1 WHERE split = 'train'
  UNION ALL SELECT 'j' || jd_id::varchar, text FROM jds""")
sql_view("sampled", ("v1", "jds"), """SELECT * FROM (SELECT 't' || bio_id::varchar AS doc, text FROM v1 WHERE split = 'train' ORDER BY sha256('3|' || bio_id::varchar) LIMIT 100)
  UNION ALL SELECT 'j' || jd_id::varchar, text FROM jds""")
_TOK = "SELECT {k} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#]*')) AS token FROM {t}"
for name, tab, key in (("ctf", "corpus", "doc"), ("qtf", "jds", "jd_id"), ("dtf", "v1", "bio_id")):
    sql_view(name, (tab,), f"SELECT k, token, count(*) AS tf FROM ({_TOK.format(k=key, t=tab)}) WHERE token NOT IN {STOPS} GROUP BY 1, 2")
sql_view("cstat", ("corpus", "ctf"), "SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(tf) FROM ctf) / (SELECT count(*) FROM corpus) AS avgdl")
sql_view("braw", ("ctf", "cstat"), "SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ctf, cstat GROUP BY 1")
sql_view("bidf", ("braw",), "SELECT token, df, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM braw) END AS idf FROM braw")
sql_view("dl", ("v1", "dtf"), "SELECT bio_id, coalesce(sum(tf), 0) AS dl FROM v1 LEFT JOIN dtf ON dtf.k = v1.bio_id GROUP BY 1")
sql_view("bm25", ("pairs", "qtf", "dtf", "dl", "bidf", "cstat"), """SELECT p.jd_id, p.bio_id, p.bio_gender, p.rel_binary, p.rel_graded, p.pool_set, coalesce(s.score, 0) AS score FROM pairs p LEFT JOIN (
  SELECT p.jd_id, p.bio_id, sum(q.tf * i.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl.dl / c.avgdl))) AS score FROM pairs p JOIN qtf q ON q.k = p.jd_id
  JOIN dtf d ON d.k = p.bio_id AND d.token = q.token JOIN bidf i ON i.token = q.token JOIN dl ON dl.bio_id = p.bio_id, cstat c GROUP BY 1, 2) s USING (jd_id, bio_id)""")
sql_view("tidf", ("ctf", "cstat"), "SELECT token, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM ctf, cstat GROUP BY 1")
for name, src in (("qw", "qtf"), ("dw", "dtf")):
    sql_view(name, (src, "tidf"), f"SELECT k, token, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM (SELECT k, token, (1 + ln(tf)) * idf AS w FROM {src} JOIN tidf USING (token))")
sql_view("tfidf", ("pairs", "qw", "dw"), """SELECT p.jd_id, p.bio_id, p.rel_binary, p.pool_set, coalesce(s.score, 0) AS score FROM pairs p LEFT JOIN (SELECT p.jd_id, p.bio_id, sum(q.w * d.w) AS score
  FROM pairs p JOIN qw q ON q.k = p.jd_id JOIN dw d ON d.k = p.bio_id AND d.token = q.token GROUP BY 1, 2) s USING (jd_id, bio_id)""")


@query("fit_corpus", V("sampled", "SELECT doc, sha256(text) AS text_hash FROM sampled"))
def _(t):
    return L.fit_corpus(t.v1().where("split = 'train'"), t.jds(), 100, 3).select("doc", F.sha2("text", 256).alias("text_hash"))


@query("bm25_fit", V("bidf cstat", "SELECT token, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl, n AS n_docs FROM bidf, cstat"))
def _(t):
    idf, stats = L.bm25_fit(L.term_vectors(corpus(t), "doc"))
    return idf.select("token", "df", r6("idf"), F.round(stats.select("avgdl").scalar(), 6).alias("avgdl"), stats.select("n_docs").scalar().alias("n_docs"))


def bm25(t, pairs=None):
    idf, stats = L.bm25_fit(L.term_vectors(corpus(t), "doc"))
    return L.bm25_score(t.pairs() if pairs is None else pairs, L.term_vectors(t.jds(), "jd_id"), L.term_vectors(t.v1(), "bio_id"), idf, stats)


def tfidf(t, pairs=None):
    idf = L.tfidf_fit(L.term_vectors(corpus(t), "doc"))
    pairs = t.pairs() if pairs is None else pairs
    # only the texts of the wanted pairs become vectors; their ids are made distinct, so that a large corpus meets a small table
    jds, bios = (d.join(pairs.select(k).distinct(), k, "left_semi") for d, k in ((t.jds(), "jd_id"), (t.v1(), "bio_id")))
    q = L.tfidf_vectors(L.term_vectors(jds, "jd_id"), "jd_id", idf)
    d = L.tfidf_vectors(L.term_vectors(bios, "bio_id"), "bio_id", idf)
    return L.tfidf_score(pairs, q, d)


@query("bm25_score", V("bm25", "SELECT jd_id, bio_id, round(score, 6) AS score FROM bm25"))
def _(t):
    return bm25(t).select("jd_id", "bio_id", r6("score"))


@query("tfidf_fit", V("tidf", "SELECT token, df, round(idf, 6) AS idf FROM tidf"))
def _(t):
    return L.tfidf_fit(L.term_vectors(corpus(t), "doc")).select("token", "df", r6("idf"))


@query("tfidf_score", V("tfidf", "SELECT jd_id, bio_id, round(score, 6) AS score FROM tfidf"))
def _(t):
    return tfidf(t).select("jd_id", "bio_id", r6("score"))


@query("incremental_pair_scores", V("tfidf", "SELECT jd_id, bio_id, round(score, 6) AS score FROM tfidf"))
def _(t):
    base = (
        t.pairs().select("jd_id", "bio_id")
        .join(t.jds().select("jd_id", F.sha2("text", 256).alias("jd_hash")), "jd_id")
        .join(t.v1().select("bio_id", F.sha2("text", 256).alias("bio_hash")), "bio_id")
    )
    _, first = pairwise.incremental_pair_scores(base.where("bio_id % 2 = 0"), None, lambda p: tfidf(t, p))
    scores, _ = pairwise.incremental_pair_scores(base, written(first, "pair-scores"), lambda p: tfidf(t, p))
    return scores.select("jd_id", "bio_id", r6("score"))


def lexical_scorers(t) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """BM25 and TF-IDF, fitted once on the training and target texts, for (jd_id, text_id, jd_text, resume_text) rows."""
    vectors = written(L.term_vectors(corpus(t), "doc"), "corpus")
    idf, stats = (written(d, "bm25-fit") for d in L.bm25_fit(vectors))
    smooth = written(L.tfidf_fit(vectors), "tfidf-fit")
    queries = written(L.term_vectors(t.jds(), "jd_id"), "queries")

    held: list = []  # the rows last seen and the vectors of their texts, which both scorers need

    def texts(d: DataFrame) -> DataFrame:
        if not held or held[0] is not d:
            held[:] = [d, written(L.term_vectors(d.select("text_id", "resume_text").dropDuplicates(["text_id"]), "text_id", "resume_text"), "text-vectors")]
        return held[1]

    def bm25(d: DataFrame) -> DataFrame:
        return L.bm25_score(d.select("jd_id", "text_id"), queries, texts(d), idf, stats, doc_key="text_id")

    def tfidf(d: DataFrame) -> DataFrame:
        return L.tfidf_score(d.select("jd_id", "text_id"), L.tfidf_vectors(queries, "jd_id", smooth), L.tfidf_vectors(texts(d), "text_id", smooth), doc_key="text_id")

    with_state = lambda score: lambda d: score(d).withColumn("nonempty", F.col("score") > 0)
    return {"bm25": with_state(bm25), "tfidf": with_state(tfidf)}


def registry(t):
    """Two lexical scorers, and a third that is switched off."""
    return (
        pairwise.ScorerRegistry()
        .register("bm25", lambda p: bm25(t, p))
        .register("tfidf", lambda p: tfidf(t, p))
        .register("off", lambda p: p.withColumn("score", F.lit(0.0)), enabled=False)
    )


@query("score_long_table", V("bm25 tfidf", """SELECT 'bm25' AS scorer, jd_id, bio_id, round(score, 6) AS score FROM bm25 UNION ALL
 SELECT 'tfidf', jd_id, bio_id, round(score, 6) FROM tfidf"""))
def _(t):
    return registry(t).score(t.pairs().select("jd_id", "bio_id")).select("scorer", "jd_id", "bio_id", r6("score"))


sql_view("bm25_all", ("v1", "jds", "qtf", "dtf", "dl", "bidf", "cstat"), """SELECT j.jd_id, b.bio_id, round(coalesce(s.score, 0), 6) AS score FROM jds j CROSS JOIN v1 b LEFT JOIN (
  SELECT q.k AS jd_id, d.k AS bio_id, sum(q.tf * i.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * dl.dl / c.avgdl))) AS score FROM qtf q JOIN dtf d ON d.token = q.token
  JOIN bidf i ON i.token = q.token JOIN dl ON dl.bio_id = d.k, cstat c GROUP BY 1, 2) s USING (jd_id, bio_id)""")


@query("topk_candidates", V("bm25_all", """SELECT jd_id, bio_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, bio_id) AS rank FROM bm25_all) WHERE rank <= 10"""))
def _(t):
    """The ten best of all bios for every target."""
    idf, stats = (written(d, "fit") for d in L.bm25_fit(L.term_vectors(corpus(t), "doc")))
    docs, queries = written(L.term_vectors(t.v1(), "bio_id"), "docs"), written(L.term_vectors(t.jds(), "jd_id"), "queries")
    terms = written(L.query_terms(queries, "jd_id", idf), "query-terms")
    index = S.build_index(S.bm25_postings(docs, stats, "bio_id"), 2.5, written(terms.select("token").distinct(), "vocabulary"))

    def exact(pairs):
        return L.bm25_score(pairs, queries, docs.join(pairs.select("bio_id"), "bio_id", "left_semi"), idf, stats)

    return S.search(index, terms, queries, docs, exact, 10)


@query("flagship_ranking", V("bm25", """, x AS (SELECT *, round(score, 6) AS s FROM bm25),
 g AS (SELECT *, rank() OVER (PARTITION BY jd_id ORDER BY s DESC) AS st, count(*) OVER (PARTITION BY jd_id, s) AS n FROM x),
 m AS (SELECT *, coalesce(list_sum(list_transform(range(st, least(st + n - 1, 10) + 1), lambda p: 1 / log2(p + 1))), 0) / n AS dw,
   coalesce(greatest(least(st + n - 1, 10) - st + 1, 0), 0) / n AS inc10, greatest(least(st + n - 1, 5) - st + 1, 0) / n AS inc5 FROM g),
 i AS (SELECT jd_id, sum((2 ** rel_graded - 1) / log2(rn + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY rel_graded DESC) AS rn FROM x) WHERE rn <= 10 GROUP BY 1)
 SELECT jd_id, any_value(pool_set) AS pool_set, round(sum((2 ** rel_graded - 1) * dw) / nullif(any_value(idcg), 0), 6) AS "ndcg@10", round(sum(rel_binary * inc5) / 5, 6) AS "p@5",
  round(sum(rel_binary * inc10) / 10, 6) AS "p@10" FROM m JOIN i USING (jd_id) GROUP BY 1"""))
def _(t):
    d = bm25(t).withColumn("score", F.round("score", 6))
    m = ranking.pool_metrics(d, ["pool_set", "jd_id"])
    return m.select("jd_id", "pool_set", *[F.round(f"`{c}`", 6).alias(c) for c in ("ndcg@10", "p@5", "p@10")])


@query("parse_fit_score", r"""WITH a AS (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' the SCORE: ' || (conv_id % 130)::varchar || ' of 50'
   WHEN 1 THEN ' gives 12 then ' || (conv_id % 130)::varchar || '.5 / 100' WHEN 2 THEN ' I say 1234 or ' || (conv_id % 130)::varchar || '!' WHEN 3 THEN ' 1.2.3 7' ELSE '' END AS answer FROM conversations),
 s AS (SELECT *, list_filter(list_transform(regexp_extract_all(answer, '(?i)\bscore\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]+)?)', 1), lambda x: x::double), lambda x: x BETWEEN 0 AND 100)[1] AS a1,
  list_filter(list_transform(regexp_extract_all(answer, '([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:/\s*100|out of 100)', 1), lambda x: x::double), lambda x: x BETWEEN 0 AND 100)[1] AS a2,
  list_filter(list_transform(list_filter(regexp_extract_all(answer, '[0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{1,3}(\.[0-9]+)?')), lambda x: x::double), lambda x: x BETWEEN 0 AND 100)[1] AS a3 FROM a)
SELECT conv_id, turn, coalesce(a1, a2, a3) AS fit FROM s""")
def _(t):
    tail = """CASE turn % 5 WHEN 0 THEN concat(' the SCORE: ', conv_id % 130, ' of 50') WHEN 1 THEN concat(' gives 12 then ', conv_id % 130, '.5 / 100')
      WHEN 2 THEN concat(' I say 1234 or ', conv_id % 130, '!') WHEN 3 THEN ' 1.2.3 7' ELSE '' END"""
    a = t.read("conversations").select("conv_id", "turn", F.concat("text", F.expr(tail)).alias("answer"))
    return a.select("conv_id", "turn", parse_fit_score(F.col("answer")).alias("fit"))


# -------------------------------------------------------------------------------------- dense


def _mix_chain(a: str, b: str) -> str:
    from ..functions.draws import mix_sql

    return mix_sql(a, b)


@query("embed_texts", V("forms dspans", f"""
, s AS (SELECT DISTINCT form AS text FROM forms UNION SELECT DISTINCT text FROM dspans),
 g AS (SELECT text, unnest(list_transform(range(1, greatest(length(text), 1) + 1), lambda i: substr(' ' || lower(text) || ' ', i, 3))) AS g FROM s),
 m AS (SELECT text, {_mix_chain('unicode(substr(g, 1, 1))::bigint * 65536 + unicode(substr(g, 2, 1))::bigint', 'unicode(substr(g, 3, 1))::bigint')} AS m FROM g),
 v AS (SELECT text, m % 64 AS dim, sum(CASE WHEN (m // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::double AS v FROM m GROUP BY 1, 2),
 n AS (SELECT text, greatest(sqrt(sum(v * v)), 1e-12) AS norm FROM v GROUP BY 1)
SELECT text, round(sum(v / norm * (dim + 1)), 6) AS checksum, round(sum(v * v / norm / norm), 6) AS sq FROM v JOIN n USING (text) GROUP BY 1"""))
def _(t):
    # the dictionary's forms and all entities that it finds in the texts
    from .text_queries import dictionary_spans, forms

    v = embed_texts(forms(t).select(F.col("form").alias("text")).unionByName(dictionary_spans(t).select("text").distinct()))
    return v.select(
        "text", F.round(F.expr("aggregate(transform(vec, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"), 6).alias("checksum"),
        F.round(F.expr("aggregate(vec, 0D, (a, x) -> a + x * x)"), 6).alias("sq"))


sql_view("cme", ("ent",), """SELECT bag, dim, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY bag)), 1e-12) AS v FROM (SELECT bag, dim, avg(x) AS m FROM (
  SELECT bag, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim FROM ent) GROUP BY 1, 2)""")


@query("chunk_mean_embedding", V("cme ent", """, f AS (SELECT bag, dim, x FROM (SELECT bag, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim,
 row_number() OVER (PARTITION BY bag ORDER BY pos) AS rn FROM ent) WHERE false)
 SELECT c.bag, round(sum(c.v * c.dim), 6) AS mean_check, any_value(t.first_check) AS first_check FROM cme c JOIN (SELECT bag, round(list_sum(list_transform(list_zip(arg_min(embedding, pos), range(1, 65)),
 lambda z: z[1]::double * z[2])), 6) AS first_check FROM ent GROUP BY 1) t USING (bag) GROUP BY 1"""))
def _(t):
    chk = lambda n: F.round(F.expr("aggregate(transform(vec, (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x)"), 6).alias(n)
    mean = dense.chunk_mean_embedding(t.entities(), "bag").select("bag", chk("mean_check"))
    first = dense.chunk_mean_embedding(t.entities(), "bag", method="truncate").select("bag", chk("first_check"))
    return mean.join(first, "bag")


@query("dense_pair_score", V("cme bag_pairs", """SELECT p.jd_id, p.bio_id, round(sum(a.v * b.v), 6) AS score FROM bag_pairs p JOIN cme a ON a.bag = p.jd_id
 JOIN cme b ON b.bag = p.bio_id AND a.dim = b.dim GROUP BY 1, 2"""))
def _(t):
    v = dense.chunk_mean_embedding(t.entities(), "bag")
    return dense.dense_pair_score(t.bag_pairs(), v.withColumnRenamed("bag", "jd_id"), v.withColumnRenamed("bag", "bio_id")).select("jd_id", "bio_id", r6("score"))


# ----------------------------------------------------------------------------------- entities
def jd_entities(t):
    return E.first_mentions(t.entities().where("side = 'jd'").drop("side"), "bag").withColumnRenamed("bag", "jd_id")


def bio_entities(t):
    return E.first_mentions(t.entities().where("side = 'bio'").drop("side"), "bag").withColumnRenamed("bag", "bio_id")


def target_texts(t):
    """All targets with the hash of their text: the bags, one without entities after each tenth, and a copy of every seventh."""
    bags = t.entities().where("side = 'jd'").select(F.col("bag").alias("jd_id")).distinct()
    empty = bags.where("jd_id % 10 = 0").selectExpr("-1 - jd_id AS jd_id")
    named = bags.unionByName(empty).select("jd_id", F.concat(F.lit("t"), F.col("jd_id")).alias("text_hash"))
    return named.unionByName(bags.where("jd_id % 7 = 0").selectExpr("1000000000 + jd_id AS jd_id", "concat('t', jd_id) AS text_hash"))


def weighted_jd(t):
    j = jd_entities(t)
    idf, unseen = E.entity_idf(j, target_texts(t))
    return E.with_entity_weights(j, idf, unseen)


def joined(t, weights=False):
    jd = E.entity_bags(weighted_jd(t), "jd_id", ("concept", "weight")) if weights else E.entity_bags(jd_entities(t), "jd_id", ("concept",))
    return E.joined_bags(t.bag_pairs(), jd, E.entity_bags(bio_entities(t), "bio_id", ("concept",)))


def best(t, weights=False):
    return E.best_matches(joined(t, weights), ("concept", "weight") if weights else ("concept",), ("concept",))


sql_view("ntarget", ("ent",), "SELECT count(DISTINCT h) AS n FROM (SELECT bag AS h FROM ent WHERE side = 'jd' UNION ALL SELECT -1 - bag FROM ent WHERE side = 'jd' AND bag % 10 = 0)")
sql_view("eidf", ("fent", "ntarget"), """SELECT ent_key, count(DISTINCT bag) AS df, ln(((SELECT n FROM ntarget) + 1) / (count(DISTINCT bag) + 1)) + 1 AS idf
  FROM fent WHERE side = 'jd' GROUP BY 1""")
sql_view("wbest", ("best", "eidf"), """SELECT b.*, i.idf, i.idf / sum(i.idf) OVER (PARTITION BY jd_id, bio_id) AS weight FROM best b JOIN eidf i ON i.ent_key = b.jd_ent""")


@query("entity_similarity", V("sims", "SELECT jd_id, bio_id, jd_ent, bio_ent, round(sim, 6) AS sim FROM sims"))
def _(t):
    return E.entity_similarity(joined(t)).withColumn("sim", F.round("sim", 6))


@query("maxsim_mean", V("best", "SELECT jd_id, bio_id, round(avg(sim), 6) AS score FROM best GROUP BY 1, 2"))
def _(t):
    return best(t).select("jd_id", "bio_id", F.round(E.maxsim_mean(), 6).alias("score"))


@query("entity_idf", V("eidf ntarget", "SELECT ent_key, df, round(idf, 6) AS idf, round(ln((SELECT n FROM ntarget) + 1) + 1, 6) AS unseen FROM eidf"))
def _(t):
    idf, unseen = E.entity_idf(jd_entities(t), target_texts(t))
    return idf.select("ent_key", "df", r6("idf"), F.round(unseen.select("unseen").scalar(), 6).alias("unseen"))


@query("idf_weighted_maxsim", V("wbest", "SELECT jd_id, bio_id, round(sum(weight * sim), 6) AS score FROM wbest GROUP BY 1, 2"))
def _(t):
    return best(t, True).select("jd_id", "bio_id", F.round(E.idf_weighted_maxsim(), 6).alias("score"))


@query("threshold_fraction", V("best", "SELECT jd_id, bio_id, round(avg((sim >= 0.1)::int), 6) AS score FROM best GROUP BY 1, 2"))
def _(t):
    return best(t).select("jd_id", "bio_id", F.round(E.threshold_fraction(0.1), 6).alias("score"))


@query("one_to_one_match", V("sims", """, r AS (SELECT jd_id, bio_id, dense_rank() OVER (PARTITION BY jd_id, bio_id ORDER BY j_pos) AS i, dense_rank() OVER (PARTITION BY jd_id, bio_id ORDER BY r_pos) AS k, sim FROM sims),
 d AS MATERIALIZED (SELECT jd_id, bio_id, max(i) AS n, greatest(max(i) - max(k), 0) AS may_skip FROM r GROUP BY 1, 2),
 w AS MATERIALIZED (SELECT jd_id, bio_id, i, k, sim FROM r), m AS (WITH RECURSIVE p AS (SELECT jd_id, bio_id, n, may_skip, 0::bigint AS i, 0::bigint AS used, 0.0::double AS s FROM d
  UNION ALL SELECT p.jd_id, p.bio_id, p.n, p.may_skip - (w.k IS NULL)::int, p.i + 1, p.used + CASE WHEN w.k IS NULL THEN 0 ELSE (1 << (w.k - 1)::int) END, p.s + coalesce(w.sim, 0)
   FROM p JOIN (SELECT jd_id, bio_id, i, k, sim FROM w UNION ALL SELECT DISTINCT jd_id, bio_id, i, NULL, NULL FROM w) w ON w.jd_id = p.jd_id AND w.bio_id = p.bio_id AND w.i = p.i + 1
   WHERE CASE WHEN w.k IS NULL THEN p.may_skip > 0 ELSE (p.used >> (w.k - 1)::int) % 2 = 0 END) SELECT * FROM p WHERE i = n)
 SELECT jd_id, bio_id, round(max(s) / any_value(n), 6) AS score FROM m GROUP BY 1, 2"""))
def _(t):
    return joined(t).select("jd_id", "bio_id", F.round(E.one_to_one_match(), 6).alias("score"))


@query("empty_policy", V("bag_pairs best", """SELECT p.jd_id, p.bio_id, round(coalesce(s.score, 0), 6) AS score, s.score IS NOT NULL AS nonempty FROM bag_pairs p LEFT JOIN
 (SELECT jd_id, bio_id, avg(sim) AS score FROM best WHERE jd_id % 3 <> 0 AND bio_id % 5 <> 0 GROUP BY 1, 2) s USING (jd_id, bio_id)"""))
def _(t):
    jd = E.entity_bags(jd_entities(t).where("jd_id % 3 <> 0"), "jd_id")
    bio = E.entity_bags(bio_entities(t).where("bio_id % 5 <> 0"), "bio_id")
    return E.empty_policy(t.bag_pairs(), jd, bio, E.maxsim_mean()).withColumn("score", F.round("score", 6))


@query("explain_matches", V("best", "SELECT jd_id, bio_id, jd_ent, bio_ent, round(sim, 6) AS sim FROM best"))
def _(t):
    return E.explain_matches(best(t)).select("jd_id", "bio_id", "jd_ent", "bio_ent", r6("sim"))


@query("requirement_report", V("wbest", """SELECT * FROM (SELECT jd_id, bio_id, round(sum(weight * sim) OVER w, 6) AS score, row_number() OVER (w ORDER BY weight * (1 - sim) DESC, j_pos) AS rank, jd_ent, bio_ent,
 round(sim, 6) AS sim, round(weight, 6) AS weight, round(weight * sim, 6) AS contribution, round(weight * (1 - sim), 6) AS lost FROM wbest WINDOW w AS (PARTITION BY jd_id, bio_id)) WHERE rank <= 12"""))
def _(t):
    d = E.requirement_report(best(t, True), top=12)
    return d.select("jd_id", "bio_id", r6("score"), "rank", "jd_ent", "bio_ent", *[r6(c) for c in ("sim", "weight", "contribution", "lost")])


@query("matched_gaps_suggestions", V("best", """SELECT jd_id, bio_id, count_if(sim >= 0.2) AS total_matched, count(*) AS total_requirements, round_even(count_if(sim >= 0.2) / count(*) * 100, 1) AS match_percent,
 coalesce(string_agg(jd_ent, ',' ORDER BY jd_ent) FILTER (sim >= 0.2), '') AS matched, coalesce(string_agg(jd_ent, ',' ORDER BY jd_ent) FILTER (sim < 0.2), '') AS gaps,
 coalesce(string_agg(jd_ent, ',' ORDER BY jd_ent) FILTER (sim >= 0.1 AND sim < 0.2), '') AS suggestions FROM best GROUP BY 1, 2"""))
def _(t):
    return E.matched_gaps_suggestions(best(t), 0.2, 0.1)
