"""Sources, cleaning, title mapping and pools as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import n_words, normalize_title, order_hash
from ..operators import cleaning, pools, titles
from ..operators.titles import TitleRule, TitleRules
from ..sources import readers, rules, writers
from ..sources.storage import shared_dir
from .catalog import query
from .views import N_CANDIDATES, N_RELEVANT, POOL_SEED, sql_view, with_views as V

NW = r"len(regexp_extract_all({}, '[^\s\p{{Z}}\x0B\x1C-\x1F\x85]+'))"
SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[‐-―]', '-', 'g'), '[/|,;:()\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"


# ------------------------------------------------------------------------------------ sources
@query("read_labelled_texts", V("v1", f"""
SELECT split || '-' || bio_id::varchar AS bio_id, (bio_id % 28)::int AS occupation_id, (bio_id % 2)::int AS gender_id, split,
  list_extract({list(rules.CLASSES)}, (bio_id % 28)::int + 1) AS occupation,
  CASE WHEN bio_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender, {NW.format('text')} AS n_words, sha256(trim(text)) AS text_hash FROM v1"""))
def _(t):
    path = shared_dir(t.spark, "labelled")
    t.v1().selectExpr(
        "bio_id AS row_id", "text AS hard_text", "cast(bio_id % 28 AS int) AS profession", "cast(bio_id % 2 AS int) AS gender", "split"
    ).write.partitionBy("split").parquet(path)
    d = readers.read_labelled_texts(t.spark, path)
    return d.withColumn("text_hash", F.sha2("text", 256)).drop("text")


sql_view("clean_p", ("postings",), f"""SELECT 'li-' || job_id::varchar AS jd_id, job_id, trim(title) AS title, {NORM.format('title')} AS title_norm,
  {SQUASH.format('description')} AS text FROM postings""")
sql_view("kept_p", ("clean_p",), f"""SELECT * FROM (SELECT *, {NW.format('text')} AS n_words, row_number() OVER (PARTITION BY text ORDER BY job_id) AS rn
  FROM clean_p) WHERE n_words >= 50 AND rn = 1""")


def _postings_csv(t):
    path = shared_dir(t.spark, "postings")
    t.postings().selectExpr("cast(job_id AS string) AS job_id", "title", "description", "'x' AS company").write.options(
        header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


@query("read_postings", V("kept_p", "SELECT jd_id, title, title_norm, sha256(text) AS text_hash, n_words FROM kept_p"))
def _(t):
    d = readers.read_postings(t.spark, _postings_csv(t), 50)
    return d.withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query("postings_audit", V("postings clean_p", f"""SELECT (SELECT count(*) FROM postings) AS raw, (SELECT count_if(title IS NULL OR description IS NULL) FROM postings) AS missing,
  count_if(nw < 50) AS too_short, count_if(nw >= 50) - count(DISTINCT CASE WHEN nw >= 50 THEN text END) AS duplicate, count(DISTINCT CASE WHEN nw >= 50 THEN text END) AS kept
  FROM (SELECT text, {NW.format('text')} AS nw FROM clean_p WHERE title IS NOT NULL AND text IS NOT NULL)"""))
def _(t):
    return readers.postings_audit(readers.read_csv_columns(t.spark, _postings_csv(t), ["job_id", "title", "description"]), 50)


@query("read_labelled_names", """SELECT 'Zu' || chr(10) || lower(chr((65 + s_suppkey % 26)::int)) AS label, CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, count(*) AS n FROM supplier GROUP BY 1, 2""")
def _(t):
    path = shared_dir(t.spark, "labelled-names")
    d = t.read("supplier").selectExpr("concat('Zu\n', lower(chr(cast(65 + s_suppkey % 26 AS int)))) AS label", "CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender")
    writers.write_csv(d.groupBy("label", "gender").agg(F.count(F.lit(1)).alias("n")), path)
    return readers.read_labelled_names(t.spark, path)


@query("read_taxonomy", V("postings", f"""
, tax AS (SELECT 'u' || job_id::varchar AS concept_id, CASE WHEN job_id % 2 = 0 THEN 'knowledge' ELSE 'skill' END AS label,
   list_filter([trim(title), trim(lower(title)), trim(regexp_replace(title, '[^A-Za-z ]', '', 'g'))], lambda x: length(x) > 0) AS forms
   FROM postings WHERE job_id % 7 <> 3),
 dis AS (SELECT concept_id, label, forms, list_filter(range(1, len(forms) + 1), lambda i: list_position(forms, forms[i]) = i) AS keep FROM tax WHERE len(forms) > 0)
SELECT concept_id, label, forms[1] AS preferred, u.k - 1 AS form_pos, forms[keep[u.k]] AS form
FROM dis, LATERAL (SELECT unnest(range(1, len(keep) + 1)) AS k) u"""))
def _(t):
    path = shared_dir(t.spark, "taxonomy")
    t.postings().selectExpr(
        "concat('u', job_id) AS conceptUri", "CASE WHEN job_id % 2 = 0 THEN 'knowledge' ELSE 'skill/competence' END AS skillType",
        "title AS preferredLabel", "concat(lower(title), '\n', regexp_replace(title, '[^A-Za-z ]', '')) AS altLabels", "'' AS hiddenLabels",
        "CASE WHEN job_id % 7 = 3 THEN 'obsolete' WHEN job_id % 7 = 2 THEN '' ELSE 'released' END AS status", "'n' AS scopeNote",
    ).write.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)
    return readers.read_taxonomy(t.spark, path).drop("concept_pos")


@query("read_token_sentences", V("pred gold w", """
SELECT s.doc_id AS idx, s.n_tokens, coalesce(p.n, 0) AS n_skill_tags, coalesce(g.n, 0) AS n_knowledge_tags, s.source FROM
 (SELECT doc_id, lang AS source, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_tokens FROM documents) s
 LEFT JOIN (SELECT doc_id, sum("end" - start)::bigint AS n FROM pred GROUP BY 1) p USING (doc_id)
 LEFT JOIN (SELECT doc_id, sum("end" - start)::bigint AS n FROM gold GROUP BY 1) g USING (doc_id)"""))
def _(t):
    path = shared_dir(t.spark, "sentences")
    toks = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))

    def bio(k):
        def tag(x, i):
            prev = F.get(F.col("tokens"), i - 1)
            return F.when(F.length(x) < k, "O").when((i == 0) | (F.length(prev) < k), "B").otherwise("I")
        return F.transform("tokens", tag)

    t.read("documents").select(F.col("doc_id").alias("idx"), toks.alias("tokens"), F.col("lang").alias("source")).withColumns(
        {"tags_skill": bio(7), "tags_knowledge": bio(6)}
    ).write.json(path)
    n_tags = lambda c: F.size(F.filter(c, lambda x: x != "O")).cast("bigint")
    return readers.read_token_sentences(t.spark, path).select(
        "idx", F.size("tokens").cast("bigint").alias("n_tokens"), n_tags("tags_skill").alias("n_skill_tags"),
        n_tags("tags_knowledge").alias("n_knowledge_tags"), "source",
    )


def name_rows(t):
    """Events as yearly name counts: 26 names, mostly of one sex, with a year and a count."""
    return t.read("events").selectExpr(
        "concat(chr(cast(65 + user_id % 26 AS int)), 'amy') AS name", "CASE WHEN (event_id % (user_id % 26 + 2) = 0) = (user_id % 2 = 0) THEN 'M' ELSE 'F' END AS sex",
        "cast(1940 + event_id % 60 AS int) AS year", "event_id % 97 + 1 AS count",
    )


sql_view("names", (), """SELECT chr((65 + user_id % 26)::int) || 'amy' AS name, CASE WHEN (event_id % (user_id % 26 + 2) = 0) = (user_id % 2 = 0) THEN 'M' ELSE 'F' END AS sex,
  (1940 + event_id % 60)::int AS year, event_id % 97 + 1 AS count FROM events""")


def names_path(t):
    path = shared_dir(t.spark, "names")
    name_rows(t).write.parquet(path)
    return path


@query("read_name_counts", V("names", "SELECT name, sex, sum(count)::bigint AS count FROM names WHERE year BETWEEN 1950 AND 1980 GROUP BY 1, 2"))
def _(t):
    return readers.read_name_counts(t.spark, names_path(t), 1950, 1980)


def edges_path(t):
    path = shared_dir(t.spark, "edges")
    labels = t.read("embeddings").select("label").distinct()
    up = labels.selectExpr("concat('c', label) AS conceptUri", "concat('p', cast(floor(label/2) AS bigint)) AS broaderUri", "'x' AS note")
    direct = labels.where("label IN (1, 3)").selectExpr("concat('c', label)", "concat('c', label - 1)", "'x'")
    writers.write_csv(up.union(direct), path)
    return path


sql_view("edges", (), """SELECT DISTINCT 'c' || label::varchar AS "conceptUri", 'p' || (label//2)::varchar AS "broaderUri" FROM embeddings
  UNION SELECT DISTINCT 'c' || label::varchar, 'c' || (label-1)::varchar FROM embeddings WHERE label IN (1, 3)""")


@query("read_concept_edges", V("edges", 'SELECT "conceptUri", "broaderUri" FROM edges'))
def _(t):
    return readers.read_concept_edges(t.spark, edges_path(t))


@query("rule_tables", f"""WITH r AS (SELECT unnest({[w[0] for w in rules.WORD_SWAPS]}) AS source),
 tok AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS source FROM documents UNION ALL
         SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM conversations)
 SELECT r.source, count(tok.source) AS n_hits, 0::bigint AS n_duplicate_rules FROM r LEFT JOIN tok USING (source) GROUP BY 1""")
def _(t):
    swaps = rules.word_swap_table(t.spark)
    dup = rules.duplicate_sources(swaps)
    words = lambda d: d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("source"))
    hits = words(t.read("documents")).unionAll(words(t.read("conversations"))).groupBy("source").agg(F.count(F.lit(1)).alias("n_hits"))
    return (
        swaps.select("source").join(hits, "source", "left").na.fill(0, ["n_hits"])
        .join(dup.select("source", F.col("n").alias("n_duplicate_rules")), "source", "left").na.fill(0, ["n_duplicate_rules"])
    )


@query("read_rating_logs", V("v6", "SELECT annotator, pair_id::varchar AS pair_id, rating::int AS rating, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM v6"))
def _(t):
    path = shared_dir(t.spark, "ratings")
    t.ratings().selectExpr(
        "annotator", "cast(pair_id AS string) AS pair_id", "cast(rating AS int) AS rating", "'' AS comment",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS timestamp_utc",
    ).write.partitionBy("annotator").option("header", True).csv(path)
    return readers.read_rating_logs(t.spark, path).select("annotator", "pair_id", "rating", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def saved_scores(t):
    path = shared_dir(t.spark, "scores")
    d = t.scores_long().selectExpr("scorer", "split", "'original' AS condition", "jd_id", "bio_id", "bio_gender", "changed", "sign", "score", "nonempty", "rel_graded")
    writers.write_scores(d, path)
    return path


@query("write_tables", V("sl", "SELECT scorer, split, count(*) AS n_rows, round(sum(score), 6) AS total FROM sl GROUP BY 1, 2"))
def _(t):
    return readers.read_scores(t.spark, saved_scores(t)).groupBy("scorer", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("score"), 6).alias("total")
    )


@query("read_scores_filtered", V("sl", """SELECT scorer, jd_id, count(*) AS n_rows, round(avg(score), 6) AS mean_score
 FROM sl WHERE split = 'dev' GROUP BY 1, 2"""))
def _(t):
    return readers.read_scores(t.spark, saved_scores(t), ["dev"], ["original"]).groupBy("scorer", "jd_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@query("file_manifest")
def _(t):
    return readers.file_manifest(t.spark, t.path, "*.parquet")


@query("name_counts_from_triples", """
SELECT 'g' || (c_custkey % 37)::varchar AS name, k.gender, count(*) AS n FROM customer,
 (VALUES ('F', 0), ('M', 1)) AS k(gender, bit) WHERE c_nationkey % 5 = 0 AND ((c_custkey % 37) % 3 = k.bit OR (c_custkey % 37) % 3 = 2)
GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t):
    c = t.read("customer").selectExpr("concat('q', c_custkey) AS s", "c_custkey % 37 AS g", "c_nationkey")
    names = c.selectExpr("concat('g', g) AS s", "g % 3 AS k").distinct()
    triples = (
        c.selectExpr("s", "'citizen' AS p", "concat('n', c_nationkey % 5) AS o")
        .unionAll(c.selectExpr("s", "'given_name'", "concat('g', g)"))
        .unionAll(names.where("k <> 1").selectExpr("s", "'name_class'", "'female'"))
        .unionAll(names.where("k <> 0").selectExpr("s", "'name_class'", "'male'"))
    )
    return readers.name_counts_from_triples(triples, "n0", {"female": "F", "male": "M"}, 3)


# ----------------------------------------------------------------------------------- cleaning
@query("filter_short", V("v1", f"SELECT bio_id, split, {NW.format('text')} AS n_words FROM v1 WHERE {NW.format('text')} >= 5"))
def _(t):
    return cleaning.filter_short(t.v1()).select("bio_id", "split", n_words(F.col("text")).alias("n_words"))


@query("dedup_keep_first", V("v1", """SELECT bio_id, split FROM (SELECT bio_id, split, row_number() OVER (PARTITION BY split, text ORDER BY bio_id) AS rn
 FROM v1) WHERE rn = 1"""))
def _(t):
    return cleaning.dedup_keep_first(t.v1(), ["split"]).select("bio_id", "split")


sql_view("cl", ("v1",), f"""SELECT *, short OR dup OR leak AS out_ FROM (SELECT *, NOT short AND row_number() OVER (PARTITION BY split, text ORDER BY bio_id) > 1 AS dup,
  NOT short AND min(r) OVER (PARTITION BY text) < r AS leak FROM (SELECT *, {NW.format('text')} < 5 AS short,
  CASE split WHEN 'train' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END AS r FROM v1))""")


@query("drop_cross_split_leaks", V("cl", "SELECT bio_id, split FROM cl WHERE NOT out_"))
def _(t):
    return cleaning.clean_texts(t.v1()).select("bio_id", "split")


@query("cleaning_audit", V("cl", """SELECT split, count(*) AS raw, count_if(short) AS too_short, count_if(dup) AS duplicate_in_split,
 count_if(leak AND NOT dup) AS overlaps_earlier_split, count_if(NOT out_) AS kept FROM cl GROUP BY 1"""))
def _(t):
    return cleaning.cleaning_audit(t.v1())


SPLIT_AT = {"train": 0.65, "dev": 0.10, "test": 0.25}


@query("stratified_split", V("v1", """, s AS (SELECT bio_id, row_number() OVER (PARTITION BY occupation, gender ORDER BY sha256('13|' || bio_id::varchar)) - 1 AS pos,
  count(*) OVER (PARTITION BY occupation, gender) AS n FROM v1)
 SELECT bio_id, CASE WHEN pos < round_even(n * 0.65::double, 0) THEN 'train' WHEN pos < round_even(n * 0.65::double, 0) + round_even(n * 0.1::double, 0) THEN 'dev' ELSE 'test' END AS new_split FROM s"""))
def _(t):
    return cleaning.stratified_split(t.v1(), ["occupation", "gender"], 13, SPLIT_AT).select("bio_id", "new_split")


@query("seeded_subset", V("v5", """SELECT jd_id, count(*) AS n_rows, round(sum(score), 6) AS total FROM v5 WHERE jd_id IN
 (SELECT jd_id FROM (SELECT DISTINCT jd_id FROM v5) ORDER BY sha256('7|' || jd_id::varchar) LIMIT 30) GROUP BY 1"""))
def _(t):
    return cleaning.seeded_subset(t.scored(), 30, 7, "jd_id").groupBy("jd_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("score"), 6).alias("total")
    )


@query("drop_missing_and_squash", V("clean_p", "SELECT jd_id, sha256(text) AS text_hash FROM clean_p"))
def _(t):
    return cleaning.drop_missing_and_squash(t.postings(), ["title", "description"], "description").select(
        F.concat(F.lit("li-"), F.col("job_id").cast("string")).alias("jd_id"), F.sha2("description", 256).alias("text_hash")
    )


@query("require_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return checks.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("require_complete", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return checks.missing_keys(t.read("documents"), t.read("labels"), ["doc_id"])


@query("length_profile", V("v1", f"""SELECT split, count(*) AS n_rows, round(100 * avg((gender = 'F')::int), 6) AS pct_f,
 round(avg({NW.format('text')}), 6) AS mean_words, round(median({NW.format('text')}), 6) AS median_words FROM v1 GROUP BY 1"""))
def _(t):
    d = cleaning.length_profile(t.v1())
    return d.select("split", "n_rows", *[F.round(c, 6).alias(c) for c in ("pct_f", "mean_words", "median_words")])


@query("length_profile_counts", V("v1", """SELECT occupation, gender, count_if(split = 'train') AS train, count_if(split = 'dev') AS dev,
 count_if(split = 'test') AS test FROM v1 GROUP BY 1, 2"""))
def _(t):
    return cleaning.length_counts(t.v1(), ["occupation", "gender"])


# -------------------------------------------------------------------------------------- titles
# Words that occur in the given titles, in four made-up classes with every kind of rule.
PAGE_RULES = TitleRules(
    exclude_all=(r"\bhat\b",),
    rules=(
        TitleRule("english", include=(r"\bthe\b",), weak=(r"\bthat\b",), exclude=(r"\bund\b",), flag=(r"\band\b",), code="11-1011",
                  require_description=r"\b(wh\w+|for)\b"),
        TitleRule("german", include=(r"\b(und|der|die)\b",), weak=(r"\bden\b",), exclude=(r"\bthe\b",), code="11-1021"),
        TitleRule("french", include=(r"\b(de|le|la)\b",), weak=(r"\ben\b",), exclude=(), flag=(r"\bque\b",), code="11-2031", require_description=r"\bdans\b"),
        TitleRule("spanish", include=(r"\b(el|los)\b",), weak=(r"\b(de|en)\b",), exclude=(r"\ble\b",), code="13-1011"),
    ),
)


def _unicode(pattern: str) -> str:
    """The checking engine has ASCII word boundaries only: spell out the Unicode ones."""
    return r"(?i)(?:^|[^\p{L}\p{N}_])" + pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]") + r"(?:[^\p{L}\p{N}_]|$)"


def _match_sql() -> str:
    q = lambda pats: " OR ".join(f"regexp_matches(title_norm, '{_unicode(p)}')" for p in pats) or "false"
    parts = []
    for r in PAGE_RULES.rules:
        opened = f"NOT ({q(PAGE_RULES.exclude_all)}) AND NOT ({q(r.exclude)})"
        parts.append((r.name, f"({opened}) AND ({q(r.include)})", f"({opened}) AND CASE WHEN {q(r.include)} THEN {q(r.flag)} ELSE {q(r.weak)} END"))
    lists = lambda k: "list_filter([" + ", ".join(f"CASE WHEN {p[k]} THEN '{p[0]}' END" for p in parts) + "], lambda x: x IS NOT NULL)"
    return f"SELECT *, {lists(1)} AS strong, {lists(2)} AS weak FROM tc"


sql_view("tc", ("clean_p",), "SELECT title_norm, count(*) AS n_postings, arg_min(title, job_id) AS example_title FROM clean_p GROUP BY 1")
sql_view("mt", ("tc",), _match_sql())
sql_view("ts", ("mt",), """SELECT title_norm, n_postings, example_title, CASE WHEN len(strong) = 1 THEN strong[1] ELSE '' END AS auto_occupation,
  array_to_string(strong || list_filter(weak, lambda x: NOT list_contains(strong, x)), '|') AS candidates,
  CASE WHEN len(strong) = 1 AND len(weak) = 0 THEN 'auto' ELSE 'ambiguous' END AS status,
  CASE WHEN len(strong) = 1 AND len(weak) = 0 THEN '' WHEN len(strong) = 1 THEN 'flagged / weak match: ' || array_to_string(weak, '|')
       WHEN len(strong) > 1 THEN 'matches several occupations' ELSE 'weak pattern only' END AS note
  FROM mt WHERE len(strong) > 0 OR len(weak) > 0""")
# earlier decisions: every third ambiguous title is decided
sql_view("rv", ("ts",), """SELECT title_norm, CASE WHEN length(title_norm) % 3 = 0 THEN 'none' WHEN length(title_norm) % 3 = 1 THEN ' french ' ELSE ' ' END
  AS reviewed_occupation FROM ts WHERE status = 'ambiguous' OR length(title_norm) % 5 = 0""")
sql_view("cr", ("ts", "rv"), """SELECT ts.*, coalesce(nullif(trim(rv.reviewed_occupation), ''), '') AS reviewed_occupation FROM ts LEFT JOIN rv USING (title_norm)""")
sql_view("fm", ("cr",), """SELECT title_norm, CASE WHEN reviewed_occupation <> '' THEN reviewed_occupation ELSE auto_occupation END AS occupation
  FROM cr WHERE reviewed_occupation NOT IN ('', 'none') OR (reviewed_occupation = '' AND status = 'auto')""")


def _named(t):
    return t.postings().select(
        F.col("job_id").alias("jd_id"), F.trim("title").alias("title"), normalize_title(F.col("title")).alias("title_norm"),
        F.trim(F.regexp_replace("description", r"\s+", " ")).alias("text"),
    )


def _matched(t):
    return titles.match_titles(titles.title_counts(_named(t)), PAGE_RULES)


def _status(t):
    return titles.title_status(_matched(t))


def _old_reviews(t):
    return _status(t).where("status = 'ambiguous' OR length(title_norm) % 5 = 0").selectExpr(
        "title_norm", "CASE WHEN length(title_norm) % 3 = 0 THEN 'none' WHEN length(title_norm) % 3 = 1 THEN ' french ' ELSE ' ' END AS reviewed_occupation"
    )


@query("normalize_title", V("clean_p", "SELECT job_id, title_norm FROM clean_p"))
def _(t):
    return _named(t).select(F.col("jd_id").alias("job_id"), "title_norm")


@query("title_counts", V("tc", "SELECT * FROM tc"))
def _(t):
    return titles.title_counts(_named(t))


@query("match_titles", V("mt", "SELECT title_norm, array_to_string(strong, '|') AS strong, array_to_string(weak, '|') AS weak FROM mt"))
def _(t):
    return _matched(t).select("title_norm", F.array_join("strong", "|").alias("strong"), F.array_join("weak", "|").alias("weak"))


@query("title_status", V("ts", "SELECT * FROM ts"))
def _(t):
    return _status(t)


@query("review_priority", V("ts", """, filled AS (SELECT auto_occupation AS o, sum(n_postings) AS n FROM ts WHERE status = 'auto' GROUP BY 1),
 scarce AS (SELECT unnest(['english', 'german', 'french', 'spanish']) AS o EXCEPT SELECT o FROM filled WHERE n >= 20)
 SELECT title_norm, status, candidates, n_postings, CASE WHEN status <> 'ambiguous' THEN ''
  WHEN len(list_intersect(string_split(candidates, '|'), (SELECT coalesce(list(o), []) FROM scarce))) > 0 THEN 'high' ELSE 'low' END AS review_priority FROM ts"""))
def _(t):
    d = titles.review_order(titles.review_priority(_status(t), PAGE_RULES.names(), 20))
    return d.select("title_norm", "status", "candidates", "n_postings", "review_priority")


@query("carry_reviews", V("cr", "SELECT title_norm, status, reviewed_occupation FROM cr"))
def _(t):
    return titles.carry_reviews(_status(t), _old_reviews(t)).select("title_norm", "status", "reviewed_occupation")


@query("validate_reviews", V("cr", "SELECT title_norm, reviewed_occupation FROM cr WHERE reviewed_occupation NOT IN ('english', 'german', 'none', '')"))
def _(t):
    d = titles.carry_reviews(_status(t), _old_reviews(t))
    return titles.validate_reviews(d, ["english", "german"]).select("title_norm", "reviewed_occupation")


@query("final_mapping", V("fm", "SELECT * FROM fm"))
def _(t):
    return titles.final_mapping(titles.carry_reviews(_status(t), _old_reviews(t)))


@query("description_requirement", V("fm clean_p", f"""SELECT occupation AS mapped, count_if((occupation = 'english' AND NOT regexp_matches(text, '{_unicode(PAGE_RULES.rules[0].require_description)}'))
 OR (occupation = 'french' AND NOT regexp_matches(text, '{_unicode(PAGE_RULES.rules[2].require_description)}'))) AS n_dropped FROM clean_p JOIN fm USING (title_norm) GROUP BY 1"""))
def _(t):
    mapping = titles.final_mapping(titles.carry_reviews(_status(t), _old_reviews(t)))
    d = _named(t).join(mapping, "title_norm").withColumn("mapped", F.col("occupation"))
    return titles.description_dropped(titles.description_requirement(d, PAGE_RULES), "mapped")


# --------------------------------------------------------------------------------------- pools
@query("relevance_binary", V("pairs", "SELECT jd_id, bio_id, rel_binary FROM pairs"))
def _(t):
    return t.pairs().select("jd_id", "bio_id", pools.relevance_binary(F.col("jd_occ"), F.col("bio_occ")).alias("rel_binary"))


@query("relevance_graded", V("pairs codes", """SELECT jd_id, bio_id, CASE WHEN jd_occ = bio_occ THEN 2 WHEN a.code[1:4] = b.code[1:4] THEN 1 ELSE 0 END AS rel_minor,
 rel_graded AS rel_major FROM pairs JOIN codes a ON a.class = jd_occ JOIN codes b ON b.class = bio_occ"""))
def _(t):
    codes = t.class_codes()
    d = t.pairs().select("jd_id", "bio_id", "jd_occ", "bio_occ")
    d = pools.relevance_graded(d, codes, "minor").withColumnRenamed("rel_graded", "rel_minor")
    d = pools.relevance_graded(d, codes, "major").withColumnRenamed("rel_graded", "rel_major")
    return d.select("jd_id", "bio_id", "rel_minor", "rel_major")


@query("related_classes", V("codes", "SELECT a.class, b.class AS related FROM codes a JOIN codes b ON a.code[1:2] = b.code[1:2] AND a.class <> b.class"))
def _(t):
    return pools.related_classes(t.class_codes())


def posting_queries(t):
    """Conversations as targets with a class: enough of them per class to sample."""
    return t.read("conversations").where("turn = 0").selectExpr("conv_id AS jd_id", "conv_id % 20 AS occ_no")


sql_view("cj", (), "SELECT conv_id AS jd_id, conv_id % 20 AS occ_no FROM conversations WHERE turn = 0")
sql_view("sq", ("cj",), """SELECT jd_id, occ_no, CASE WHEN pos < round_even(least(n, 6) * 0.3::double, 0) THEN 'dev' ELSE 'test' END AS pool_set FROM (
  SELECT *, row_number() OVER (PARTITION BY occ_no ORDER BY sha256('5|' || jd_id::varchar)) - 1 AS pos, count(*) OVER (PARTITION BY occ_no) AS n FROM cj)
  WHERE n >= 3 AND pos < least(n, 6)""")


@query("select_queries", V("sq cj", """SELECT c.occ_no, c.available, coalesce(s.used, 0) AS used, coalesce(s.dev, 0) AS dev, coalesce(s.test, 0) AS test,
  coalesce(s.ids, '') AS ids FROM (SELECT occ_no, count(*) AS available FROM cj GROUP BY 1) c LEFT JOIN (SELECT occ_no, count(*) AS used,
  count_if(pool_set = 'dev') AS dev, count_if(pool_set = 'test') AS test, string_agg(jd_id::varchar, ',' ORDER BY jd_id) AS ids FROM sq GROUP BY 1) s USING (occ_no)"""))
def _(t):
    jds = posting_queries(t)
    chosen = pools.select_queries(jds, 6, 3, 0.3, 5)
    ids = chosen.groupBy("occ_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("jd_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return pools.query_coverage(jds, chosen).join(ids, "occ_no", "left").na.fill("", ["ids"])


@query("build_pools", V("pool_u", "SELECT * FROM pool_u"))
def _(t):
    return pools.build_pools(*t.pool_inputs(), N_CANDIDATES, N_RELEVANT, POOL_SEED, codes=t.class_codes())


@query("build_pools_proportional", V("pool_p", "SELECT * FROM pool_p"))
def _(t):
    return pools.build_pools(*t.pool_inputs(), N_CANDIDATES, N_RELEVANT, POOL_SEED, "proportional", codes=t.class_codes())


@query("pool_checks", V("pool_u", f"""SELECT *, n_rows = {N_CANDIDATES} AND n_bios = {N_CANDIDATES} AND n_f = {N_CANDIDATES // 2} AND n_rel = {N_RELEVANT} AND n_rel_f = {N_RELEVANT // 2} AS ok FROM (SELECT jd_id, count(*) AS n_rows,
 count(DISTINCT bio_id) AS n_bios, count_if(bio_gender = 'F') AS n_f, sum(rel_binary)::bigint AS n_rel, count_if(rel_binary = 1 AND bio_gender = 'F') AS n_rel_f FROM pool_u GROUP BY 1)"""))
def _(t):
    return pools.pool_checks(pools.build_pools(*t.pool_inputs(), N_CANDIDATES, N_RELEVANT, POOL_SEED), N_CANDIDATES, N_RELEVANT)
