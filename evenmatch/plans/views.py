"""The given tables seen as bios, target descriptions, pairs, entity bags, scores and ratings.

Every view exists twice: as a DataFrame and as the common table expression used by the SQL checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import written

CLASSES = 20
N_CANDIDATES, N_RELEVANT, POOL_SEED = 100, 10, 11  # of each target's pool
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


class Tables:
    """Lazy access to the tables below one folder, and the views built on them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps of a query read: made and written at its first use."""
        if name not in self._made:
            self._made[name] = written(make(), name)
        return self._made[name]

    def read(self, name: str) -> DataFrame:
        """Scan one table. Text columns cost far more CPU than I/O, so a text table that arrives in
        fewer partitions than there are cores (few small files) is spread first; a table of many
        files is left as it is scanned."""
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        key = SPREAD_KEYS.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, key)
        return df

    def v1(self) -> DataFrame:
        """Documents as labelled bios."""
        return self.read("documents").selectExpr(
            "doc_id AS bio_id", "text", "lang", "source AS occupation", f"doc_id % {CLASSES} AS occ_no",
            "CASE WHEN floor(doc_id/20) % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "CASE WHEN floor(doc_id/40) % 5 < 3 THEN 'train' WHEN floor(doc_id/40) % 5 = 3 THEN 'dev' ELSE 'test' END AS split",
        )

    def jds(self) -> DataFrame:
        """Benchmark passages as target descriptions."""
        return self.read("benchmark").selectExpr(
            "item_id AS jd_id", "text", f"item_id % {CLASSES} AS occ_no",
            "CASE WHEN item_id % 10 < 3 THEN 'dev' ELSE 'test' END AS pool_set",
        )

    def class_codes(self) -> DataFrame:
        """Class codes of the numbered classes: five classes share a major group, two a minor group."""
        return self.v1().select("occ_no").distinct().selectExpr(
            "occ_no AS class", "concat(cast(11 + cast(floor(occ_no/5) AS int) AS string), '-', cast(cast(floor(occ_no/2) AS int) % 9 + 1 AS string), '011') AS code"
        )

    def pool_inputs(self) -> tuple[DataFrame, DataFrame]:
        bios = self.v1().selectExpr("bio_id", "occ_no AS bio_occ", "gender AS bio_gender")
        return bios, self.jds().selectExpr("jd_id", "occ_no AS jd_occ")

    def pools(self) -> DataFrame:
        """The pool of every target, drawn from all bios; written once per query."""
        from ..operators.pools import build_pools

        return self.once("pools", lambda: build_pools(*self.pool_inputs(), N_CANDIDATES, N_RELEVANT, POOL_SEED, codes=self.class_codes()).select(
            "jd_id", "jd_occ", "bio_id", "bio_occ", "bio_gender", "rel_binary", "rel_graded"))

    def pairs(self) -> DataFrame:
        """Every target with all bios of its pool: what the scorers are run on."""
        sets = self.jds().select("jd_id", "pool_set")
        return self.pools().join(sets, "jd_id").select("jd_id", "bio_id", "bio_gender", "jd_occ", "bio_occ", "pool_set", "rel_binary", "rel_graded")

    def postings(self) -> DataFrame:
        return self.read("pages").select(
            F.col("page_id").alias("job_id"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.regexp_replace("html", "<[^>]*>", " ").alias("description"),
        )

    def entities(self) -> DataFrame:
        """Vectors as entity mentions in bags of five; even bags are targets, odd bags are bios."""
        return self.read("embeddings").selectExpr(
            "cast(floor(vec_id/5) AS bigint) AS bag", "vec_id AS pos", "concat('k', cast((vec_id*7) % 37 AS string)) AS ent_key",
            "concat('c', cast(label AS string)) AS concept", "embedding",
            "CASE WHEN floor(vec_id/5) % 2 = 0 THEN 'jd' ELSE 'bio' END AS side",
        )

    def bag_pairs(self) -> DataFrame:
        """Each target bag with the ten bio bags that follow it."""
        bags = self.entities().select("bag", "side").distinct()
        jd = bags.where("side = 'jd'").select(
            F.col("bag").alias("jd_id"), F.explode(F.array(*[F.lit(o) for o in range(1, 20, 2)])).alias("d")
        )
        return jd.selectExpr("jd_id", "jd_id + d AS bio_id").join(
            bags.where("side = 'bio'").select(F.col("bag").alias("bio_id")), "bio_id"
        ).select("jd_id", "bio_id")

    def scored(self) -> DataFrame:
        """The scored pairs, written once per query: every metric after them reads the saved table."""
        return self.once("scored", self._scored_pairs)

    def _scored_pairs(self) -> DataFrame:
        """Line items as scored pairs: supplier = pool, order line = candidate.

        Ranges of (pool, candidate) keep a pool together, so later counts per pool and score shrink before
        they are shuffled, and a pool of any size is still spread over several ranges.
        """
        return self.read("lineitem").repartitionByRange("l_suppkey", "l_orderkey").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(
            # statuses are F and O: the least is F when any is (a number keeps the aggregate hash-based)
            F.expr("max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)").alias("_f"),
            F.expr("max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)").alias("rel_graded"),
            F.expr("max(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END)").alias("rel_binary"),
            F.max("l_quantity").alias("score"),
            F.expr("max(cast(floor(l_extendedprice/1000) AS double))").alias("score_b"),
            F.expr("max(cast(l_partkey % 50 AS double))").alias("score_c"),
            F.expr("max(CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END)").alias("changed"),
            F.expr("max(cast(floor(l_discount*100) AS double)) - 5").alias("shift"),
        ).selectExpr(
            "l_suppkey AS jd_id", "l_orderkey * 10 + l_linenumber AS bio_id", "l_suppkey % 7 AS jd_occupation",
            "CASE WHEN l_suppkey % 10 < 3 THEN 'dev' ELSE 'test' END AS split",
            "CASE WHEN _f = 1 THEN 'F' ELSE 'M' END AS bio_gender",
            "rel_graded", "rel_binary", "score", "score_b", "score_c", "changed", "shift",
        )

    def scores_long(self) -> DataFrame:
        """One row per (scorer, pair), with the rewritten text's score beside the original one."""
        return self.scored().selectExpr(
            "split", "jd_id", "bio_id", "jd_occupation", "bio_gender", "rel_graded", "rel_binary", "changed", "shift",
            "CASE WHEN bio_gender = 'M' THEN 1 ELSE -1 END AS sign",
            "stack(3, 'a', score, 'b', score_b, 'c', score_c) AS (scorer, score)",
        ).selectExpr("*", "score > 2 AS nonempty")

    def audited(self) -> DataFrame:
        """scores_long under two conditions: a real rewrite, and one that changes nothing."""
        return self.scores_long().selectExpr(
            "scorer", "split", "jd_id", "bio_id", "jd_occupation", "bio_gender", "rel_graded", "rel_binary", "sign",
            "score", "nonempty", "shift", "changed AS _c", "stack(2, 'swap', 1, 'noop', 0) AS (condition, _on)",
        ).selectExpr(
            "scorer", "split", "condition", "jd_id", "bio_id", "jd_occupation", "bio_gender", "rel_graded", "rel_binary",
            "sign", "score", "nonempty", "_c * _on AS changed", "score + _c * _on * shift AS pert_score",
            "(score + _c * _on * shift) > 2 AS pert_nonempty",
        )

    def ratings(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id % 300 AS pair_id", "concat('a', cast(user_id % 3 AS string)) AS annotator",
            "cast(floor(value) AS bigint) % 4 AS rating", "ts", "event_id",
        )

    def word_spans(self, min_len: int) -> DataFrame:
        """Maximal runs of words of at least ``min_len`` letters, as labelled spans of a document."""
        from ..operators.spans import runs

        docs = self.read("documents").select(
            F.col("doc_id"), F.col("lang").alias("source"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("tokens")
        )
        docs = docs.withColumn("long", F.transform("tokens", lambda t: F.length(t) >= min_len))
        return (
            docs.select("doc_id", "source", "tokens", F.explode(runs(F.col("long"))).alias("s"))
            .select(
                "doc_id", "source", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                F.expr("CASE WHEN s.start % 2 = 0 THEN 'skill' ELSE 'knowledge' END").alias("label"),
                F.expr("array_join(slice(tokens, s.start + 1, s.end - s.start), ' ')").alias("text"),
            )
        )


# ---------------------------------------------------------------- the same views as SQL text
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v1": ((), f"""SELECT doc_id AS bio_id, text, lang, source AS occupation, doc_id % {CLASSES} AS occ_no,
        CASE WHEN (doc_id//20) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CASE WHEN (doc_id//40) % 5 < 3 THEN 'train' WHEN (doc_id//40) % 5 = 3 THEN 'dev' ELSE 'test' END AS split
        FROM documents"""),
    "jds": ((), f"""SELECT item_id AS jd_id, text, item_id % {CLASSES} AS occ_no,
        CASE WHEN item_id % 10 < 3 THEN 'dev' ELSE 'test' END AS pool_set FROM benchmark"""),
    "pairs": (("pool_u", "jds"), """SELECT p.jd_id, p.bio_id, p.bio_gender, p.jd_occ, p.bio_occ, j.pool_set, p.rel_binary, p.rel_graded
        FROM pool_u p JOIN jds j USING (jd_id)"""),
    "postings": ((), """SELECT page_id AS job_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_replace(html, '<[^>]*>', ' ', 'g') AS description FROM pages"""),
    "ent": ((), """SELECT vec_id//5 AS bag, vec_id AS pos, 'k' || ((vec_id*7) % 37)::varchar AS ent_key,
        'c' || label::varchar AS concept, embedding,
        CASE WHEN (vec_id//5) % 2 = 0 THEN 'jd' ELSE 'bio' END AS side FROM embeddings"""),
    "bag_pairs": (("ent",), """SELECT a.bag AS jd_id, b.bag AS bio_id FROM (SELECT DISTINCT bag FROM ent WHERE side='jd') a
        JOIN (SELECT DISTINCT bag FROM ent WHERE side='bio') b ON b.bag > a.bag AND b.bag - a.bag <= 19"""),
    # one entity per (bag, key): its first mention
    "fent": (("ent",), """SELECT bag, side, ent_key, pos, concept, embedding FROM (
        SELECT *, row_number() OVER (PARTITION BY bag, ent_key ORDER BY pos) AS rn FROM ent) WHERE rn = 1"""),
    "sims": (("bag_pairs", "fent"), """SELECT p.jd_id, p.bio_id, j.ent_key AS jd_ent, j.pos AS j_pos, j.concept AS jd_concept,
        r.ent_key AS bio_ent, r.pos AS r_pos, r.concept AS bio_concept,
        list_sum(list_transform(list_zip(j.embedding, r.embedding), lambda z: z[1]::double * z[2]::double)) AS sim
        FROM bag_pairs p JOIN fent j ON j.bag = p.jd_id JOIN fent r ON r.bag = p.bio_id"""),
    "best": (("sims",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id, bio_id, jd_ent
        ORDER BY sim DESC, r_pos) AS rn FROM sims) WHERE rn = 1"""),
    "v5": ((), """SELECT l_suppkey AS jd_id, l_orderkey * 10 + l_linenumber AS bio_id, l_suppkey % 7 AS jd_occupation,
        CASE WHEN l_suppkey % 10 < 3 THEN 'dev' ELSE 'test' END AS split,
        CASE WHEN min(l_linestatus) = 'F' THEN 'F' ELSE 'M' END AS bio_gender,
        max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS rel_graded,
        max(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) AS rel_binary,
        max(l_quantity) AS score, max(floor(l_extendedprice/1000)) AS score_b, max((l_partkey % 50)::double) AS score_c,
        max(CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END) AS changed, max(floor(l_discount*100)) - 5 AS shift
        FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber"""),
    "sl": (("v5",), """SELECT * EXCLUDE (score, score_b, score_c, sc), sc AS score, CASE WHEN bio_gender = 'M' THEN 1 ELSE -1 END AS sign,
        sc > 2 AS nonempty FROM (SELECT *, 'a' AS scorer, score AS sc FROM v5 UNION ALL SELECT *, 'b', score_b FROM v5
        UNION ALL SELECT *, 'c', score_c FROM v5)"""),
    "au": (("sl",), """SELECT * EXCLUDE (changed, shift), changed * on_ AS changed, score + changed * on_ * shift AS pert_score,
        (score + changed * on_ * shift) > 2 AS pert_nonempty
        FROM sl, (VALUES ('swap', 1), ('noop', 0)) AS c(condition, on_)"""),
    "v6": ((), """SELECT event_id % 300 AS pair_id, 'a' || (user_id % 3)::varchar AS annotator,
        floor(value)::bigint % 4 AS rating, ts, event_id FROM events"""),
    "lat": (("v6",), "SELECT annotator, pair_id, arg_max(rating, ts) AS rating FROM v6 GROUP BY 1, 2"),
    "w": ((), """SELECT doc_id, lang AS source, u.tok AS tok, u.pos - 1 AS pos FROM documents,
        LATERAL (SELECT unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS t)) u"""),
    "pred": (("w",), """SELECT doc_id, source, min(pos) AS start, max(pos) + 1 AS "end",
        CASE WHEN min(pos) % 2 = 0 THEN 'skill' ELSE 'knowledge' END AS label, string_agg(tok, ' ' ORDER BY pos) AS text
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM w WHERE length(tok) >= 7)
        GROUP BY doc_id, source, isl"""),
    "gold": (("w",), """SELECT doc_id, source, min(pos) AS start, max(pos) + 1 AS "end",
        CASE WHEN min(pos) % 2 = 0 THEN 'skill' ELSE 'knowledge' END AS label, string_agg(tok, ' ' ORDER BY pos) AS text
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM w WHERE length(tok) >= 6)
        GROUP BY doc_id, source, isl"""),
}


def sql_view(name: str, needs: tuple[str, ...], body: str) -> None:
    _SQL[name] = (needs, body)


# the class codes, the bios in their positions, the slots of each target, and the pools
sql_view("codes", ("v1",), "SELECT DISTINCT occ_no AS class, (11 + occ_no//5)::varchar || '-' || ((occ_no//2) % 9 + 1)::varchar || '011' AS code FROM v1")
_H = "('0x' || substr(sha256({}), 1, 12))::bigint"
sql_view("ix", ("v1",), """SELECT bio_id, occ_no AS bio_occ, gender AS bio_gender, row_number() OVER (PARTITION BY occ_no, gender ORDER BY sha256('11|' || bio_id::varchar)) - 1 AS idx,
  count(*) OVER (PARTITION BY occ_no, gender) AS n FROM v1""")
sql_view("sz", ("ix",), "SELECT bio_occ, bio_gender, count(*) AS n FROM ix GROUP BY 1, 2")
sql_view("relslots", ("sz", "jds"), f"""SELECT jd_id, occ_no AS jd_occ, bio_occ, bio_gender, ({_H.format("'11|' || jd_id::varchar || '|' || bio_gender")} + s) % n AS idx
  FROM jds JOIN sz ON sz.bio_occ = jds.occ_no, range({N_RELEVANT // 2}) AS r(s) WHERE s < n""")
sql_view("uni", ("sz", "jds"), f"""SELECT jd_id, jd_occ, bio_occ, bio_gender, (st + turn) % n AS idx FROM (
  SELECT jd_id, occ_no AS jd_occ, bio_occ, bio_gender, n, {_H.format("'11|' || jd_id::varchar || '|' || bio_gender || '|' || bio_occ::varchar")} AS st,
   row_number() OVER (PARTITION BY jd_id, bio_gender ORDER BY sha256('11|' || jd_id::varchar || '|' || bio_occ::varchar), bio_occ) - 1 AS k,
   count(*) OVER (PARTITION BY jd_id, bio_gender) AS nc FROM jds JOIN sz ON sz.bio_occ <> jds.occ_no) q,
  LATERAL (SELECT s // nc AS turn FROM range({(N_CANDIDATES - N_RELEVANT) // 2}) AS r(s) WHERE s % nc = k) z WHERE turn < n""")
sql_view("pro", ("sz", "jds"), f"""SELECT c.jd_id, c.jd_occ, c.bio_occ, c.bio_gender, p.at_ - c.lo AS idx FROM (
  SELECT jd_id, occ_no AS jd_occ, bio_occ, bio_gender, n, sum(n) OVER (PARTITION BY jd_id, bio_gender ORDER BY bio_occ)::bigint - n AS lo FROM jds JOIN sz ON sz.bio_occ <> jds.occ_no) c
  JOIN (SELECT jd_id, bio_gender, ({_H.format("'11|' || jd_id::varchar || '|' || bio_gender")} + (s * m) // least({(N_CANDIDATES - N_RELEVANT) // 2}, m)) % m AS at_ FROM
   (SELECT jd_id, bio_gender, sum(n)::bigint AS m FROM jds JOIN sz ON sz.bio_occ <> jds.occ_no GROUP BY 1, 2), range({(N_CANDIDATES - N_RELEVANT) // 2}) AS r(s) WHERE s < m) p
  ON p.jd_id = c.jd_id AND p.bio_gender = c.bio_gender AND p.at_ >= c.lo AND p.at_ < c.lo + c.n""")
sql_view("pool_u", ("relslots", "uni", "ix", "codes"), """SELECT s.jd_id, s.jd_occ, ix.bio_id, ix.bio_occ, ix.bio_gender, CASE WHEN s.jd_occ = ix.bio_occ THEN 1 ELSE 0 END AS rel_binary,
  CASE WHEN s.jd_occ = ix.bio_occ THEN 2 WHEN a.code[1:2] = b.code[1:2] THEN 1 ELSE 0 END AS rel_graded FROM
  (SELECT * FROM relslots UNION ALL SELECT * FROM uni) s JOIN ix ON ix.bio_occ = s.bio_occ AND ix.bio_gender = s.bio_gender AND ix.idx = s.idx
  JOIN codes a ON a.class = s.jd_occ JOIN codes b ON b.class = ix.bio_occ""")
sql_view("pool_p", ("relslots", "pro", "ix", "codes"), """SELECT s.jd_id, s.jd_occ, ix.bio_id, ix.bio_occ, ix.bio_gender, CASE WHEN s.jd_occ = ix.bio_occ THEN 1 ELSE 0 END AS rel_binary,
  CASE WHEN s.jd_occ = ix.bio_occ THEN 2 WHEN a.code[1:2] = b.code[1:2] THEN 1 ELSE 0 END AS rel_graded FROM
  (SELECT * FROM relslots UNION ALL SELECT * FROM pro) s JOIN ix ON ix.bio_occ = s.bio_occ AND ix.bio_gender = s.bio_gender AND ix.idx = s.idx
  JOIN codes a ON a.class = s.jd_occ JOIN codes b ON b.class = ix.bio_occ""")


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (space separated) and all they need; a leading comma adds more views."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _SQL[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_SQL[n][1]})" for n in order) + "\n" + body.lstrip("\n")
