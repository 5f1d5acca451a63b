"""Text units, dictionary spans and entities as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WORD_OR_MARK, find_all, layout_to_sentences
from ..operators import spans as S, textunits
from ..sources.rules import GENERIC_NOUNS, STOP_WORDS
from ..sources.storage import written
from .catalog import query
from .views import sql_view, with_views as V

WM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
GENERIC = "(" + ", ".join(f"'{w}'" for w in GENERIC_NOUNS) + ")"

sql_view("lex", ("v1",), f"""SELECT bio_id, tok AS token, row_number() OVER (PARTITION BY bio_id ORDER BY i) - 1 AS pos FROM (
  SELECT bio_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT bio_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#]*') AS l FROM v1))
  WHERE tok NOT IN {STOPS}""")


@query("lexical_tokens", V("lex", "SELECT bio_id, token, count(*) AS tf, min(pos) AS first_pos FROM lex GROUP BY 1, 2"))
def _(t):
    d = textunits.lexical_tokens(t.v1(), stop_words=STOP_WORDS)
    return d.groupBy("bio_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").cast("bigint").alias("first_pos"))


@query("token_windows", V("v1", r"""
, p AS (SELECT bio_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT bio_id, regexp_extract_all(text, '\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS l FROM v1)),
 k AS (SELECT *, (row_number() OVER (PARTITION BY bio_id ORDER BY i) - 1) // 64 AS win FROM p WHERE NOT regexp_matches(piece, '^\s+$')),
 b AS (SELECT bio_id, win, min(i) AS lo, max(i) AS hi FROM k GROUP BY 1, 2)
SELECT b.bio_id, b.win, sha256(string_agg(p.piece, '' ORDER BY p.i)) AS window_hash FROM b JOIN p ON p.bio_id = b.bio_id AND p.i BETWEEN b.lo AND b.hi GROUP BY 1, 2"""))
def _(t):
    return textunits.token_windows(t.v1(), 64).select("bio_id", "win", F.sha2("window_text", 256).alias("window_hash"))


@query("split_sentences", V("v1", rf"""
, s AS (SELECT bio_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) AS l FROM v1),
 u AS (SELECT bio_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS sent FROM s),
 g AS (SELECT bio_id, sent, CASE WHEN sent = 0 THEN 0 ELSE strpos(x, chr(2)) - 1 END AS lead, CASE WHEN sent = 0 THEN x ELSE substr(x, strpos(x, chr(2)) + 1) END AS sentence FROM u),
 c AS (SELECT *, len(regexp_extract_all(sentence, '{WM}')) AS n_tokens, sum(lead + length(sentence)) OVER (PARTITION BY bio_id ORDER BY sent)::bigint AS end_char FROM g)
SELECT bio_id, sent, sha256(sentence) AS sentence_hash, end_char - length(sentence) AS start_char, end_char,
 (sum(n_tokens) OVER (PARTITION BY bio_id ORDER BY sent) - n_tokens)::bigint AS start_token, n_tokens FROM c QUALIFY n_tokens > 0"""))
def _(t):
    d = textunits.split_sentences(t.v1())
    return d.withColumn("sentence_hash", F.sha2("sentence", 256)).drop("sentence")


@query("layout_to_sentences", V("v1", r"""SELECT bio_id, sha256(CASE WHEN strpos(text, chr(10)) = 0 THEN text ELSE array_to_string(list_transform(list_filter(
 list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]'),
  lambda x: regexp_replace(regexp_replace(x, '^[\s\x{2022}\x{25aa}\x{25cf}\x{2013}\x{2014}*\-\x{00b7}]+', ''), '^\s+|\s+$', '', 'g')),
 lambda x: length(x) > 0), lambda x: CASE WHEN right(x, 1) IN ('.', '!', '?', ':', ';', ',') THEN x ELSE x || '.' END), chr(10)) END) AS text_hash FROM v1"""))
def _(t):
    return t.v1().select("bio_id", F.sha2(layout_to_sentences(F.col("text")), 256).alias("text_hash"))


# ---------------------------------------------------------------------------------- dictionary
def forms(t):
    """A dictionary that covers the benchmark passages: forms of two, one, three and four words in turn."""
    toks = find_all(F.col("text"), WORD_OR_MARK)
    return (
        t.read("benchmark").withColumn("t", toks)
        .select(
            F.concat(F.lit("b"), F.col("item_id")).alias("concept_id"), F.col("item_id").alias("concept_pos"),
            F.expr("CASE WHEN item_id % 2 = 0 THEN 'knowledge' ELSE 'skill' END").alias("label"),
            F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 10).cast("int")), lambda c: F.array(*[
                F.struct((4 * c + j).cast("int").alias("form_pos"), F.slice("t", 10 * c + a, n).alias("w"), F.lit(n).alias("n")) for j, (a, n) in enumerate(_TILES)
            ]))), lambda f: F.size(f["w"]) == f["n"])).alias("f"),
        )
        .select("concept_id", "concept_pos", "label", "f.form_pos", F.array_join("f.w", " ").alias("form"))
    )


_TILES = ((1, 2), (3, 1), (4, 3), (7, 4))  # first token and length of the forms in every ten tokens
sql_view("forms", (), f"""SELECT concept_id, concept_pos, label, (4 * c + j)::int AS form_pos, array_to_string(t[10 * c + a:10 * c + a + n - 1], ' ') AS form
  FROM (SELECT *, unnest(range(len(t) // 10 + 1)) AS c FROM (SELECT 'b' || item_id::varchar AS concept_id, item_id AS concept_pos, CASE WHEN item_id % 2 = 0 THEN 'knowledge' ELSE 'skill' END AS label,
  regexp_extract_all(text, '{WM}') AS t FROM benchmark)), (VALUES (0, 1, 2), (1, 3, 1), (2, 4, 3), (3, 7, 4)) v(j, a, n) WHERE len(t) >= 10 * c + a + n - 1""")
sql_view("pats", ("forms",), f"""SELECT * FROM (SELECT *, lower(form) AS key, row_number() OVER (PARTITION BY lower(form) ORDER BY concept_pos, form_pos) AS rn FROM forms
  WHERE length(form) >= 2 AND len(string_split_regex(lower(form), '\\s+')) <= 8 AND len(list_filter(string_split_regex(lower(form), '\\s+'), lambda w: w NOT IN {STOPS})) > 0) WHERE rn = 1""")


def patterns(t):
    return S.build_patterns(forms(t))


@query("build_patterns", V("pats", "SELECT key, label, form, concept_id FROM pats"))
def _(t):
    return patterns(t).select("key", "label", "form", "concept_id")


def _stem(x: str) -> str:
    c = rf"CASE WHEN length(lower({x})) <= 3 THEN lower({x}) ELSE regexp_replace(regexp_replace(regexp_replace(lower({x}), 'ies$', 'y'), '^(.{{3,}})(ing|ed)$', '\1'), '([^s])s$', '\1') END"
    return rf"CASE WHEN length({c}) <= 3 THEN {c} ELSE regexp_replace({c}, 'e$', '') END"


def _tokens_sql(table: str, key: str) -> str:
    lead = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2, 3) for c in ("tok", "stem"))
    return f"""SELECT {key}, tok, pos, stem, {lead} FROM (SELECT {key}, tok, pos, {_stem('tok')} AS stem FROM (SELECT {key}, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM
  (SELECT {key}, regexp_extract_all(text, '{WM}') AS l FROM {table}))) WINDOW w AS (PARTITION BY {key} ORDER BY pos)"""


def _spans_sql(words: str, key: str) -> str:
    grams = []
    for n in (1, 2, 3, 4):
        join = lambda c: " || ' ' || ".join([c, *[f"{c}{k}" for k in range(1, n)]])  # noqa: E731,B023
        grams.append(f"""SELECT {key}, pos AS start, pos + {n} AS "end", {join('tok')} AS text, {join('stem')} AS k FROM {words}{f" WHERE tok{n - 1} IS NOT NULL" if n > 1 else ""}""")
    return f"""SELECT g.{key}, g.start, g."end", g.text, m.label AS label, m.concept_id AS concept_id FROM ({" UNION ALL ".join(grams)}) g JOIN spats ON spats.skey = g.k"""


sql_view("wm", (), _tokens_sql("documents", "doc_id"))
sql_view("spats", ("pats",), f"""SELECT skey, min(struct_pack(concept_pos, form_pos, label, concept_id)) AS m FROM (SELECT *, array_to_string(list_transform(
  regexp_extract_all(lower(form), '{WM}'), lambda x: {_stem('x')}), ' ') AS skey FROM pats) GROUP BY 1""")
sql_view("dspans", ("wm", "spats"), _spans_sql("wm", "doc_id"))


@query("dictionary_spans", V("dspans", "SELECT * FROM dspans"))
def dictionary_spans(t):
    return S.dictionary_spans(t.read("documents"), patterns(t)).drop("source", "priority")


# Candidates with many kinds of overlap: long-word runs, the same moved by one, and medium-word runs.
def overlapping_candidates(t):
    pred, gold = t.word_spans(7), t.word_spans(6)
    moved = F.struct((F.col("start") + 1).alias("start"), (F.col("end") + 2).alias("end"))
    both = pred.select("doc_id", F.explode(F.array(F.struct("start", "end"), moved)).alias("s")).select("doc_id", "s.start", "s.end")
    # spread by text, as the choice needs them: they are shuffled once
    return both.union(gold.select("doc_id", "start", "end")).repartition("doc_id").distinct()


@query("longest_non_overlapping", V("pred gold", """
, cand AS (SELECT doc_id, start AS s, "end" AS e FROM pred UNION SELECT doc_id, start + 1, "end" + 2 FROM pred UNION SELECT doc_id, start, "end" FROM gold),
 l AS (SELECT doc_id, list([struct_pack(s, e)] ORDER BY s - e, s) AS c FROM cand GROUP BY 1),
 f AS (SELECT doc_id, list_reduce(c, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(a, x) ELSE a END) AS kept FROM l)
SELECT doc_id, k.s AS start, k.e AS "end" FROM (SELECT doc_id, unnest(kept) AS k FROM f)"""))
def _(t):
    return S.longest_non_overlapping(overlapping_candidates(t))


_RUNS = rf"""
, k AS (SELECT bio_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT bio_id, regexp_extract_all(text, '<[A-Z_]+>|{WM}') AS l FROM v1)),
 o AS (SELECT *, pos - row_number() OVER (PARTITION BY bio_id ORDER BY pos) AS isl FROM k WHERE regexp_matches(tok, '^[\p{{L}}_]') AND lower(tok) NOT IN {STOPS}),
 r AS (SELECT bio_id, min(pos) AS start, max(pos) + 1 AS "end", string_agg(tok, ' ' ORDER BY pos) AS text, lower(arg_max(tok, pos)) AS head FROM o GROUP BY bio_id, isl)"""


@query("candidate_phrases", V("v1", _RUNS + f"""
SELECT bio_id, start, "end", text FROM r WHERE length(text) >= 2 AND head NOT IN {GENERIC}"""))
def _(t):
    return textunits.candidate_phrases(t.v1()).select("bio_id", "start", "end", "text")


@query("candidate_phrases_bounded", V("v1", _RUNS + """
SELECT bio_id, start, "end", text FROM r WHERE length(text) BETWEEN 3 AND 59"""))
def _(t):
    """Phrases of 3 to 59 characters under any head word."""
    return textunits.candidate_phrases(t.v1(), generic=(), min_chars=3, max_chars=59).select("bio_id", "start", "end", "text")


# -------------------------------------------------------------------------------------- spans
OVER = 'EXISTS (SELECT 1 FROM {b} b WHERE b.doc_id = a.doc_id AND a.start < b."end" AND b.start < a."end")'


@query("suppress_overlaps", V("gold pred", f'SELECT doc_id, start, "end", text FROM gold a WHERE NOT {OVER.format(b="pred")}'))
def _(t):
    return S.suppress_overlaps(t.word_spans(6), t.word_spans(7), ["doc_id"]).select("doc_id", "start", "end", "text")


@query("union_spans", V("gold pred", """SELECT doc_id, start, "end", text, 'long' AS label FROM pred UNION ALL
 SELECT doc_id, start, "end", text, 'medium' FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.start = g.start AND p."end" = g."end")"""))
def _(t):
    a = t.word_spans(7).withColumn("label", F.lit("long"))
    b = t.word_spans(6).withColumn("label", F.lit("medium"))
    return S.union_spans([a, b]).select("doc_id", "start", "end", "text", "label")


@query("dedupe_spans", V("pred", """SELECT doc_id, start, "end", 'a' AS label FROM pred"""))
def _(t):
    a = t.word_spans(7)
    both = a.withColumns({"label": F.lit("b"), "priority": F.lit(1)}).unionByName(a.withColumns({"label": F.lit("a"), "priority": F.lit(0)}))
    return S.dedupe_spans(both).select("doc_id", "start", "end", "label")


@query("filter_spans", V("gold", """SELECT doc_id, start, "end", label, source FROM gold WHERE label = 'skill' AND source IN ('en', 'de')"""))
def _(t):
    return S.filter_spans(t.word_spans(6), ["skill"], ["en", "de"]).select("doc_id", "start", "end", "label", "source")


@query("distinct_entities", V("pred", """SELECT doc_id, lower(trim(text)) AS ent_key, arg_min(trim(text), struct_pack(start, "end", label)) AS entity, min(start) AS start,
 arg_min("end", struct_pack(start, "end", label)) AS "end" FROM pred GROUP BY 1, 2"""))
def _(t):
    return S.distinct_entities(t.word_spans(7))


@query("bio_to_spans", V("pred", 'SELECT doc_id, start, "end" FROM pred'))
def _(t):
    lengths = t.read("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).cast("bigint").alias("n_tokens"))
    tags = S.spans_to_bio(lengths, t.word_spans(7))
    # every other document opens its spans with a typed I, which must be read as a start
    loose = tags.select("doc_id", F.transform("tags", lambda x: F.when((F.col("doc_id") % 2 == 1) & (x == "B"), "I-SKILL").otherwise(x)).alias("tags"))
    return S.bio_to_spans(loose)


@query("spans_to_bio", V("w", """SELECT doc_id, string_agg(CASE WHEN length(tok) < 7 THEN 'O' WHEN pos = 0 OR prev < 7 THEN 'B' ELSE 'I' END, '' ORDER BY pos) AS tags FROM
 (SELECT *, length(lag(tok) OVER (PARTITION BY doc_id ORDER BY pos)) AS prev FROM w) GROUP BY 1"""))
def _(t):
    lengths = t.read("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).cast("bigint").alias("n_tokens"))
    return S.spans_to_bio(lengths.where("n_tokens > 0"), t.word_spans(7)).select("doc_id", F.array_join("tags", "").alias("tags"))


@query("first_mention_per_concept", V("ent", "SELECT bag, concept, arg_min(ent_key, pos) AS text FROM ent GROUP BY 1, 2"))
def _(t):
    e = t.entities().selectExpr("bag", "concept", "ent_key AS text", "pos AS start", "pos + 1 AS end")
    return S.first_mention_per_concept(e, "bag", "concept")


@query("incremental_extract", V("v1 pred", """SELECT sha256(v1.text) AS text_hash, p.start, p."end", p.text FROM v1 JOIN
 (SELECT text, min(bio_id) AS bio_id FROM v1 GROUP BY 1) f ON f.bio_id = v1.bio_id JOIN pred p ON p.doc_id = v1.bio_id"""))
def _(t):
    def extract(d):
        toks = d.select("text_hash", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("k")).withColumn(
            "f", F.transform("k", lambda x: F.length(x) >= 7))
        return toks.select("text_hash", "k", F.explode(S.runs(F.col("f"))).alias("s")).selectExpr(
            "text_hash", "s.start", "s.end", "array_join(slice(k, s.start + 1, s.end - s.start), ' ') AS text")

    texts = t.v1().select("bio_id", "text")
    _, first = S.incremental_extract(texts.where("bio_id % 2 = 0"), None, "v1", extract)
    store = written(first, "spans")
    everything, _ = S.incremental_extract(texts, store, "v1", extract)
    return everything.where("start IS NOT NULL").select("text_hash", "start", "end", "text")


@query("found_by", V("gold pred", """SELECT doc_id, lower(trim(text)) AS ent_key, string_agg(DISTINCT src, ',' ORDER BY src) AS found_by FROM
 (SELECT *, 'long' AS src FROM pred UNION ALL SELECT *, 'medium' FROM gold) GROUP BY 1, 2"""))
def _(t):
    both = t.word_spans(7).withColumn("source", F.lit("long")).unionByName(t.word_spans(6).withColumn("source", F.lit("medium")))
    return S.found_by(both)


@query("extraction_summary", V("gold pred", """, a AS (SELECT 'long' AS extractor, * FROM pred UNION ALL SELECT 'medium', * FROM gold),
 h AS (SELECT extractor, 1 - count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS empty_share FROM a GROUP BY 1)
 SELECT extractor, label, source, count(*) AS n_spans, round(any_value(empty_share), 6) AS empty_share FROM a JOIN h USING (extractor) GROUP BY 1, 2, 3"""))
def _(t):
    both = t.word_spans(7).withColumn("extractor", F.lit("long")).unionByName(t.word_spans(6).withColumn("extractor", F.lit("medium")))
    return S.extraction_summary(both, t.read("documents")).withColumn("empty_share", F.round("empty_share", 6))
