"""Counterfactual rewrites as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import match_case
from ..operators import fairness as H, resampling as J, rewrite as G
from ..sources import readers, rules as R
from ..sources.storage import written
from .audit_queries import r6
from .catalog import query
from .data_queries import names_path
from .score_queries import lexical_scorers
from .text_queries import STOPS
from .views import sql_view, with_views as V

# The invented texts hold no English pronouns, names or affiliations, so every bio ends in one of
# these sentences; {n} is a name that depends on the bio.
ENDINGS = (
    "She tuned her harp while he oiled his loom.",
    "He carried his trunk, and the key was his. Mrs. Dale greeted her.",
    "{n} is a driven glazier. {n}'s pupils admire him.",
    "Dr. {n} joined a fraternity and leads new bakers.",
    "She was lead cook; he drove demand in Turin with {n} Moss.",
    "A leading member of the Society of Women Engineers, she supported the guild.",
    "The mayor called him in 1987. THE LAST SEAT WAS HERS. Mara led crews. To be fair, they sang.",
    "Nothing here needs a change.",
)


def cf_texts(t):
    ends = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("bio_id") % len(ENDINGS)).cast("int"))
    name = F.concat(F.chr((F.lit(65) + F.col("bio_id") % 26).cast("int")), F.lit("amy"))
    return t.v1().select("bio_id", "gender", "split", F.concat("text", F.lit(" "), F.replace(ends, F.lit("{n}"), name)).alias("text"))


_E = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in ENDINGS) + "]"
sql_view("cf", ("v1",), f"SELECT bio_id, gender, split, text || ' ' || replace(({_E})[1 + (bio_id % {len(ENDINGS)})::int], '{{n}}', chr((65 + bio_id % 26)::int) || 'amy') AS text FROM v1")
sql_view("pc", ("cf",), r"SELECT bio_id, l, list_transform(l, lambda x: lower(x)) AS low FROM (SELECT bio_id, regexp_extract_all(text, '\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS l FROM cf)")


def _sqlist(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + ")"


def _case(s: str, t: str) -> str:
    up = lambda x: f"(upper({x}) = {x} AND lower({x}) <> {x})"
    return (f"CASE WHEN length({s}) = 0 THEN {t} WHEN {up(s)} AND length({s}) > 1 THEN upper({t}) WHEN {up(f'left({s}, 1)')} THEN upper(left({t}, 1)) || substr({t}, 2) "
            f"WHEN {up(f'left({t}, 1)')} AND NOT {up(t)} THEN lower(left({t}, 1)) || substr({t}, 2) ELSE {t} END")


_NEAR = "CASE WHEN regexp_full_match({a}[i {s} 1], '\\s+') THEN {a}[i {s} 2] ELSE {a}[i {s} 1] END"
_WORD = "regexp_full_match({}, '[\\p{{L}}\\p{{N}}_]+')"
_SIMPLE = {**R.PRONOUNS, **R.TITLES}
sql_view("pp_pron", ("pc",), f"""SELECT bio_id, i, i AS e, {_case('raw', 'tgt')} AS new, 'pronoun' AS kind FROM (SELECT *, CASE w WHEN 'her' THEN CASE WHEN nxt IS NULL OR NOT {_WORD.format('nxt')} OR nxt IN {_sqlist((*G.VERB_HINTS, *R.ADVERBS))} THEN 'him' ELSE 'his' END
   WHEN 'his' THEN CASE WHEN nxt IS NULL OR NOT {_WORD.format('nxt')} OR nxt IN {_sqlist(G.VERB_HINTS)} THEN 'hers' ELSE 'her' END {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIMPLE.items())} END AS tgt FROM (
  SELECT bio_id, i, l[i] AS raw, low[i] AS w, {_NEAR.format(a='low', s='+')} AS nxt FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc) WHERE low[i] IN {_sqlist(['her', 'his', *_SIMPLE])}))
  WHERE w NOT IN {_sqlist(R.TITLES)} OR regexp_matches(raw, '^\\p{{Lu}}')""")


def _rebuild(props: str) -> str:
    """Texts rebuilt from accepted proposals (bio_id, i, e, new): piece i..e becomes ``new``."""
    return f"""SELECT c.bio_id, sha256(string_agg(CASE WHEN p.i IS NOT NULL THEN p.new WHEN q.i IS NOT NULL THEN '' ELSE c.piece END, '' ORDER BY c.i)) AS text_hash, count(p.i) AS n_changes
 FROM (SELECT bio_id, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS i FROM pc) c LEFT JOIN {props} p ON p.bio_id = c.bio_id AND p.i = c.i
 LEFT JOIN (SELECT bio_id, unnest(range(i + 1, e + 1)) AS i FROM {props}) q ON q.bio_id = c.bio_id AND q.i = c.i GROUP BY 1"""


def _applied(t, part):
    d = G.pieces(cf_texts(t)).withColumn("props", part)
    return G.apply_proposals(d, "props")


def _hashed(d):
    return d.select("bio_id", F.sha2("new_text", 256).alias("text_hash"), F.col("n_changes").cast("bigint").alias("n_changes"))


@query("match_case", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS s FROM documents), x AS (SELECT s, unnest(['mentor', 'Mary', 'USA']) AS t FROM w)
 SELECT s, t, {_case('s', 't')} AS matched FROM x""")
def _(t):
    w = t.read("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("s")).distinct()
    x = w.select("s", F.explode(F.array(F.lit("mentor"), F.lit("Mary"), F.lit("USA"))).alias("t"))
    return x.select("s", "t", match_case(F.col("s"), F.col("t")).alias("matched"))


@query("swap_pronouns", V("pp_pron", _rebuild("pp_pron")))
def _(t):
    return _hashed(_applied(t, G.swap_pronouns()))


# ------------------------------------------------------------------------------------- phrases
_RULES = sorted([(p["a"], p["b"], bool(p.get("case_sensitive"))) for p in R.AFFILIATIONS]
                + [(p["b"], p["a"], False) for p in R.AFFILIATIONS if p.get("bidirectional", True)], key=lambda r: -len(G._tokens(r[0])))
_VALUES = ", ".join("({}, '{}', '{}', {})".format(k, " ".join(G._tokens(a)).replace("'", "''"), b.replace("'", "''"), str(c).lower()) for k, (a, b, c) in enumerate(_RULES))
_FIRST = _sqlist(sorted({G._tokens(a)[0].lower() for a, _, _ in _RULES}))
_KEEP = "list_filter(list_transform({l}, lambda x, i: CASE WHEN {cond} THEN i END), lambda i: i IS NOT NULL)"
sql_view("nb", ("pc",), "SELECT bio_id, " + _KEEP.format(l="l", cond=r"NOT regexp_full_match(x, '\s+')") + r" AS wi, list_filter(l, lambda x: NOT regexp_full_match(x, '\s+')) AS w FROM pc")
sql_view("nbk", ("nb",), "SELECT bio_id, wi, w, unnest(" + _KEEP.format(l="w", cond=f"lower(x) IN {_FIRST}") + ") AS k FROM nb")
sql_view("ph_all", ("nbk",), f"""SELECT bio_id, wi[k] AS i, wi[k + n - 1] AS e, w[k] AS raw, tgt, rk FROM (SELECT *, len(string_split(src, ' ')) AS n FROM nbk, (VALUES {_VALUES}) r(rk, src, tgt, cs))
  WHERE CASE WHEN cs THEN array_to_string(w[k:k + n - 1], ' ') = src ELSE lower(array_to_string(w[k:k + n - 1], ' ')) = lower(src) END""")
sql_view("pp_phr", ("ph_all",), f"""SELECT bio_id, i, e, {_case('raw', 'tgt')} AS new, 'affiliation' AS kind FROM ph_all a WHERE NOT EXISTS (SELECT 1 FROM ph_all b WHERE b.bio_id = a.bio_id AND b.i <= a.e AND a.i <= b.e
  AND (b.rk < a.rk OR (b.rk = a.rk AND b.i < a.i)))""")


@query("swap_phrases", V("pp_phr pc", _rebuild("pp_phr")))
def _(t):
    return _hashed(_applied(t, G.swap_phrases()))


# --------------------------------------------------------------------------------------- words
_BY = lambda g: [s for s, _, _, _, gs in R.WORD_SWAPS if g in gs]
_CLS = lambda c: [s for s, _, _, wc, _ in R.WORD_SWAPS if wc == c]
_far = lambda k: f"coalesce(low[i + {k}], '')"
_open = lambda k: " AND ".join(f"{_far(j)} NOT IN {_sqlist(G.SENTENCE_ENDS)}" for j in range(1, k + 1))
_AHEAD = lambda words: "(" + " OR ".join(f"({_open(k)} AND {_far(k)} IN {_sqlist(words)})" for k in range(1, 7)) + ")"
_T = " ".join(f"WHEN '{s}' THEN '{x}'" for s, x, *_ in R.WORD_SWAPS)
_D = " ".join(f"WHEN '{s}' THEN '{d}'" for s, _, d, *_ in R.WORD_SWAPS)
_I = lambda c, words: f"coalesce({c} IN {_sqlist(words)}, false)"
sql_view("pp_word", ("pc",), f"""SELECT bio_id, i, i AS e, {_case('raw', 'tgt')} AS new, kind FROM (SELECT *, CASE w {_T} END AS tgt, CASE w {_D} END AS kind FROM (
  SELECT bio_id, i, low, l[i] AS raw, low[i] AS w, {_NEAR.format(a='low', s='+')} AS nxt, {_NEAR.format(a='low', s='-')} AS prv FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc) WHERE low[i] IN {_sqlist([s for s, *_ in R.WORD_SWAPS])}))
  WHERE NOT {_I('prv', ['-'])} AND NOT {_I('nxt', ['-'])}
  AND (w NOT IN {_sqlist(_CLS('verb'))} OR (NOT {_I('prv', (*R.DETERMINERS, *R.POSSESSIVES, 's', "'", '’'))} AND NOT ({_I('prv', R.BE_FORMS)} AND w IN ('lead', 'leads'))))
  AND (w NOT IN {_sqlist(_BY('passive'))} OR NOT ({_I('prv', R.BE_FORMS)} OR {_I('nxt', ['by'])}))
  AND (w NOT IN {_sqlist(_BY('idiom'))} OR NOT ({_I('nxt', ['to', *R.PARTICLES])} OR {_AHEAD(['to', *R.FIXED_OBJECTS, *[x + 's' for x in R.FIXED_OBJECTS]])}))
  AND (w NOT IN {_sqlist(_BY('attributive'))} OR {_I('nxt', (*R.DETERMINERS, *R.POSSESSIVES, *R.PRONOUN_WORDS))})
  AND (w NOT IN {_sqlist(_CLS('modifier'))} OR ({_I('prv', (*R.DETERMINERS, *R.POSSESSIVES))} AND nxt IS NOT NULL AND {_WORD.format('nxt')} AND nxt NOT IN {_sqlist((*G.VERB_HINTS, *R.POSSESSIVES, *R.ADVERBS))}))""")


@query("rewrite_words", V("pp_word", _rebuild("pp_word")))
def _(t):
    return _hashed(_applied(t, G.rewrite_words()))


# --------------------------------------------------------------------------------------- names
def lexicon(t):
    return G.name_lexicon(readers.read_name_counts(t.spark, names_path(t), 1940, 1999), 500, extra_names(t))


def extra_names(t):
    """A second source of labelled names, from the suppliers."""
    return t.read("supplier").selectExpr("concat('Zu', lower(chr(cast(65 + s_suppkey % 26 AS int)))) AS label", "CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender").groupBy("label", "gender").agg(F.count(F.lit(1)).alias("n"))


sql_view("extra", (), "SELECT 'Zu' || lower(chr((65 + s_suppkey % 26)::int)) AS label, CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, count(*) AS n FROM supplier GROUP BY 1, 2")
sql_view("ntot", ("names",), "SELECT name, sum(CASE WHEN sex = 'F' THEN count ELSE 0 END) AS f, sum(count) AS total FROM names GROUP BY 1")
sql_view("lexn", ("ntot", "extra"), """SELECT lower(name) AS name, CASE WHEN f / total >= 0.5 THEN 'F' ELSE 'M' END AS gender, greatest(f / total, 1 - f / total) AS share FROM ntot WHERE total >= 500
  UNION ALL SELECT lower(label), min(gender), 1.0 FROM extra WHERE lower(label) NOT IN (SELECT lower(name) FROM ntot WHERE total >= 500) GROUP BY 1""")


@query("name_lexicon", V("lexn", "SELECT name, gender, round(share, 6) AS share FROM lexn"))
def _(t):
    return lexicon(t).select("name", "gender", r6("share"))


def pools(t):
    return G.name_pools(readers.read_name_counts(t.spark, names_path(t), 1940, 1999), 500, 0.9, 6, extra_names(t), 4, 5000, ["Zuc"])


sql_view("npool", ("ntot", "extra"), """SELECT pool, gender, row_number() OVER (PARTITION BY pool, gender ORDER BY name) - 1 AS idx, name, count(*) OVER (PARTITION BY pool, gender) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, gender ORDER BY weight DESC, name) AS r FROM (
  SELECT 'us' AS pool, 'F' AS gender, name, total AS weight, 6 AS k FROM ntot WHERE total >= 500 AND f / total >= 0.9 UNION ALL SELECT 'us', 'M', name, total, 6 FROM ntot WHERE total >= 500 AND 1 - f / total >= 0.9
  UNION ALL SELECT 'in', min(gender), label, max(n), 4 FROM extra WHERE regexp_full_match(label, '[A-Z][a-z]+') AND label <> 'Zuc' AND label NOT IN (SELECT name FROM ntot WHERE total >= 5000) GROUP BY label HAVING count(*) = 1)) WHERE r <= k""")


@query("name_pools", V("npool", "SELECT pool, gender, idx, name, n FROM npool"))
def _(t):
    return pools(t)


@query("pick_replacement", V("v1 lexn npool", """SELECT v.bio_id, x.name, p.name AS replacement FROM v1 v JOIN lexn x ON x.name = lower(chr((65 + v.bio_id % 26)::int)) || 'amy'
 JOIN npool p ON p.pool = 'us' AND p.gender = v.gender AND p.idx = ('0x' || substr(sha256(v.bio_id::varchar || '|' || x.name), 1, 12))::bigint % p.n"""))
def _(t):
    names = t.v1().select("bio_id", "gender", F.lower(F.concat(F.chr((F.lit(65) + F.col("bio_id") % 26).cast("int")), F.lit("amy"))).alias("name"), F.lit("us").alias("pool"))
    return G.pick_replacement(names, pools(t)).select("bio_id", "name", "replacement")


# title-case words in the same places as the operator looks at them; _A guards positions before the first piece
_A = lambda a, k: f"CASE WHEN {k} >= 1 THEN {a}[({k})::int] END"
_CAP = lambda k: f"coalesce(regexp_full_match({_A('l', k)}, '\\p{{Lu}}\\p{{Ll}}+') AND {_A('low', k)} NOT IN {_sqlist(R.STOP_WORDS)}, false)"
_BLANK = lambda k: f"coalesce(regexp_full_match({_A('l', k)}, '\\s+'), false)"
_NEXT = lambda k: f"(CASE WHEN {_BLANK(k + ' + 1')} THEN {_A('low', k + ' + 2')} ELSE {_A('low', k + ' + 1')} END)"
_PREV = lambda k: f"(CASE WHEN {_BLANK(k + ' - 1')} THEN {_A('low', k + ' - 2')} ELSE {_A('low', k + ' - 1')} END)"
_TITLED = lambda k: f"""(coalesce({_PREV(k)} IN {_sqlist(R.NAME_TITLES)}, false) OR coalesce({_PREV(k)} = '.' AND
  (CASE WHEN {_BLANK(k + ' - 1')} THEN {_A('low', k + ' - 3')} ELSE {_A('low', k + ' - 2')} END) IN {_sqlist(R.NAME_TITLES)}, false))"""  # noqa: E731
_VERBS = _sqlist((*R.AUXILIARIES, "s"))
sql_view("nm_at", ("pc", "lexn"), f"""SELECT bio_id, name, titled, joined_before AND NOT titled_before AS inner_, joined_before AND NOT joined_after AS surname, NOT joined_after AND NOT joined_before AS alone,
  coalesce((NOT joined_after AND NOT joined_before) OR ((prv IS NULL OR prv IN ('.', '!', '?')) AND NOT joined_before) OR nxt IN ('''', '’') OR (joined_after AND (
   after2 IN {_VERBS} OR regexp_full_match(after2, '[a-z]+s') OR after3 IN {_VERBS})), false) AS subject FROM (
  SELECT bio_id, low[i] AS name, {_TITLED('i')} AS titled, {_TITLED('(i - 2)')} AS titled_before, {_CAP('i + 2')} AND {_BLANK('i + 1')} AS joined_after, {_CAP('i - 2')} AND {_BLANK('i - 1')} AS joined_before,
   {_NEXT('i')} AS nxt, {_PREV('i')} AS prv, low[i + 4] AS after2, low[i + 6] AS after3
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc) WHERE {_CAP('i')} AND low[i] IN (SELECT name FROM lexn WHERE share >= 0.9))""")
sql_view("subj", ("nm_at", "lexn", "cf"), """SELECT n.bio_id, n.name, cf.gender AS own FROM (SELECT bio_id, name, bool_or(surname) AS surname, bool_or(subject) AS subject,
  bool_or(NOT titled AND NOT inner_ AND NOT alone) AS head, bool_or(NOT titled AND alone) AS alone FROM nm_at GROUP BY 1, 2) n JOIN lexn USING (name) JOIN cf ON cf.bio_id = n.bio_id
  WHERE (head OR (alone AND NOT surname)) AND subject AND lexn.gender = cf.gender AND share >= 0.9""")
sql_view("picks", ("subj", "npool"), """SELECT s.bio_id, s.name, p.pool, CASE WHEN p.gender = s.own THEN 'same' ELSE 'opposite' END AS target, p.name AS replacement FROM subj s JOIN npool p
  ON p.idx = ('0x' || substr(sha256(s.bio_id::varchar || '|' || s.name), 1, 12))::bigint % p.n""")


@query("swap_names", V("picks", """SELECT bio_id, string_agg(name, ',' ORDER BY name) AS names, string_agg(replacement, ',' ORDER BY replacement) AS replacements FROM picks
 WHERE pool = 'us' AND target = 'opposite' GROUP BY 1"""))
def _(t):
    d = G.pieces(cf_texts(t), low=False)
    return G.swap_names(d, lexicon(t), pools(t), "us", "opposite", 0.9).select("bio_id", F.expr("array_join(array_sort(map_keys(names)), ',')").alias("names"), F.expr("array_join(array_sort(map_values(names)), ',')").alias("replacements"))


# ------------------------------------------------------------------------- merge and conditions
# a second part that wants every "her" and every word before a full stop, so that both kinds of overlap occur
sql_view("pp_caps", ("pc",), "SELECT bio_id, i, i + 1 AS e, 'X' AS new, 'caps' AS kind FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc) WHERE low[i] IN ('her', 'his', 'team', 'junior') AND l[i + 1] IS NOT NULL")
sql_view("pp_merged", ("pp_pron", "pp_caps"), """SELECT *, 0 AS part FROM pp_pron UNION ALL SELECT *, 1 FROM pp_caps c WHERE NOT EXISTS (SELECT 1 FROM pp_pron p WHERE p.bio_id = c.bio_id AND p.i <= c.e AND c.i <= p.e)""")
sql_view("log", ("pp_merged", "pc"), """SELECT bio_id, kind, original, new AS replacement, orig_start, orig_start + length(original) AS orig_end,
  (orig_start + coalesce(sum(length(new) - length(original)) OVER (PARTITION BY bio_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start_char FROM (
  SELECT m.bio_id, m.i, m.kind, m.new, array_to_string(c.l[m.i:m.e], '') AS original, length(array_to_string(c.l[1:m.i - 1], '')) AS orig_start FROM pp_merged m JOIN pc c USING (bio_id))""")


def _merged(t):
    found = F.transform("low", lambda x, i: F.when(x.isin("her", "his", "team", "junior") & F.get("p", i + 1).isNotNull(), F.struct(
        i.cast("int").alias("start"), (i + 2).cast("int").alias("end"), F.lit("X").alias("new"), F.lit("caps").alias("kind"), F.lit("").alias("note"))))
    d = G.pieces(cf_texts(t)).withColumns({"a": G.swap_pronouns(), "b": F.array_compact(found)})
    return G.apply_proposals(d.withColumn("props", G.merge_proposals([F.col("a"), F.col("b")])), "props")


@query("merge_and_apply", V("log", "SELECT bio_id, kind, original, replacement, orig_start::bigint AS orig_start, orig_end::bigint AS orig_end, start_char, start_char + length(replacement) AS end_char FROM log WHERE original <> replacement"))
def _(t):
    d = _merged(t).select("bio_id", F.explode(F.transform("changes", lambda x: x)).alias("c"))
    big = lambda c: F.col(f"c.{c}").cast("bigint").alias(c)
    return d.select("bio_id", "c.kind", "c.original", "c.replacement", big("orig_start"), big("orig_end"), big("start_char"), big("end_char"))


ORIENTATION = {"agentic_communal": "communal", "default": "gender"}


def rewrites(t, pool=None):
    """All seven rewrites of every bio, or of the bios of a pool table."""
    texts = cf_texts(t)
    if pool is not None:
        texts = texts.join(pool.select("bio_id").distinct(), "bio_id", "left_semi")
    return G.generate_conditions(texts, lexicon(t), pools(t), min_share=0.9, carry=("split",))


# the proposals of every condition; in the last one a name gives way to a pronoun at its place
sql_view("pp_name", ("picks", "pc"), f"""SELECT bio_id, pool, target, i, i AS e, {_case('raw', 'replacement')} AS new, 'name' AS kind FROM (
  SELECT c.bio_id, c.i, c.raw, m.pool, m.target, m.replacement FROM (SELECT bio_id, i, l[i] AS raw, low[i] AS name, {_TITLED('i')} AS titled FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc)
   WHERE low[i] IN (SELECT name FROM picks) AND regexp_full_match(l[i], '\\p{{Lu}}\\p{{Ll}}+')) c JOIN picks m ON m.bio_id = c.bio_id AND m.name = c.name WHERE NOT c.titled)""")
_COLS = "bio_id, i, e, new, kind"
sql_view("pp_cond", ("pp_pron", "pp_name", "pp_phr", "pp_word"), f"""SELECT 'pronoun_swap' AS condition, {_COLS} FROM pp_pron UNION ALL SELECT 'affiliation_swap', {_COLS} FROM pp_phr UNION ALL SELECT 'agentic_communal', {_COLS} FROM pp_word
  UNION ALL SELECT 'name_swap_us', {_COLS} FROM pp_name WHERE pool = 'us' AND target = 'opposite' UNION ALL SELECT 'name_swap_in', {_COLS} FROM pp_name WHERE pool = 'in' AND target = 'opposite'
  UNION ALL SELECT 'name_in_same_gender', {_COLS} FROM pp_name WHERE pool = 'in' AND target = 'same' UNION ALL SELECT 'gender_full', {_COLS} FROM pp_pron
  UNION ALL SELECT 'gender_full', {_COLS} FROM pp_name n WHERE pool = 'us' AND target = 'opposite' AND NOT EXISTS (SELECT 1 FROM pp_pron p WHERE p.bio_id = n.bio_id AND p.i <= n.e AND n.i <= p.e)""")
sql_view("cond_log", ("pp_cond", "pc"), """SELECT condition, bio_id, i, kind, original, new, orig_start, orig_start + length(original) AS orig_end, (orig_start + coalesce(sum(length(new) - length(original)) OVER b, 0))::bigint AS start_char,
  coalesce(lag(orig_start + length(original)) OVER b0, 0) AS before FROM (SELECT m.condition, m.bio_id, m.i, m.kind, m.new, array_to_string(c.l[m.i:m.e], '') AS original, length(array_to_string(c.l[1:m.i - 1], ''))::bigint AS orig_start
   FROM pp_cond m JOIN pc c USING (bio_id)) WINDOW b AS (PARTITION BY condition, bio_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b0 AS (PARTITION BY condition, bio_id ORDER BY i)""")
sql_view("rw", ("cf", "cond_log"), """SELECT cf.bio_id, cf.gender, cf.split, c.condition, coalesce(l.n, 0) AS n_changes, coalesce(l.changes, '') AS changes, coalesce(l.a2c, 0) AS a2c, coalesce(l.c2a, 0) AS c2a,
  CASE WHEN l.head IS NULL THEN cf.text ELSE l.head || substr(cf.text, l.last + 1) END AS text
  FROM cf CROSS JOIN (SELECT unnest(['pronoun_swap', 'name_swap_us', 'name_swap_in', 'name_in_same_gender', 'affiliation_swap', 'agentic_communal', 'gender_full']) AS condition) c
  LEFT JOIN (SELECT k.condition, k.bio_id, count_if(original <> new) AS n, string_agg(kind || '|' || original || '|' || new || '|' || orig_start::varchar || '|' || start_char::varchar, ';' ORDER BY i) FILTER (original <> new) AS changes,
   count_if(kind = 'agentic->communal' AND original <> new) AS a2c, count_if(kind = 'communal->agentic' AND original <> new) AS c2a,
   string_agg(substr(cf.text, before + 1, orig_start - before) || new, '' ORDER BY i) AS head, max(orig_end) AS last FROM cond_log k JOIN cf USING (bio_id) GROUP BY 1, 2) l ON l.bio_id = cf.bio_id AND l.condition = c.condition""")


@query("generate_conditions", V("rw", "SELECT bio_id, condition, n_changes > 0 AS changed, n_changes::int AS n_changes, sha256(text) AS text_hash, changes FROM rw"))
def _(t):
    log = F.transform("changes", lambda c: F.concat_ws("|", c["kind"], c["original"], c["replacement"], c["orig_start"], c["start_char"]))
    return rewrites(t).select("bio_id", "condition", "changed", "n_changes", F.sha2("text", 256).alias("text_hash"), F.array_join(log, ";").alias("changes"))


@query("perturbation_coverage", V("rw", """SELECT condition, split, count(*) AS n_bios, round(100 * avg((n_changes > 0)::int), 6) AS pct_changed, round(100 * avg((n_changes > 0)::int) FILTER (gender = 'F'), 6) AS pct_changed_f,
 round(100 * avg((n_changes > 0)::int) FILTER (gender = 'M'), 6) AS pct_changed_m, round(avg(n_changes) FILTER (n_changes > 0), 6) AS mean_changes FROM rw GROUP BY 1, 2"""))
def _(t):
    d = G.perturbation_coverage(rewrites(t), ["condition", "split"])
    return d.select("condition", "split", "n_bios", *[r6(c) for c in ("pct_changed", "pct_changed_f", "pct_changed_m", "mean_changes")])


@query("qa_samples", V("rw cond_log", """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY sha256('13|' || condition || '|' || bio_id::varchar)) AS sample FROM rw WHERE n_changes > 0) WHERE sample <= 50),
 k AS (SELECT t.condition, t.sample, t.bio_id, t.text, c.i, c.start_char, c.start_char + length(c.new) AS end_char, c.new FROM top t JOIN cond_log c ON c.bio_id = t.bio_id AND c.condition = t.condition WHERE c.original <> c.new),
 g AS (SELECT *, coalesce(lag(end_char) OVER (PARTITION BY condition, bio_id ORDER BY i), 0) AS prev FROM k)
 SELECT condition, sample, bio_id, string_agg(substr(text, prev + 1, start_char - prev) || '**' || new || '**', '' ORDER BY i) || substr(any_value(text), max(end_char) + 1) AS marked FROM g GROUP BY 1, 2, 3"""))
def _(t):
    return G.qa_samples(rewrites(t), 50, 13)


@query("change_context", V("log pc", """, n AS (SELECT bio_id, string_agg(CASE WHEN p.i IS NOT NULL THEN p.new WHEN q.i IS NOT NULL THEN '' ELSE c.l[c.i] END, '' ORDER BY c.i) AS t
 FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pc) c LEFT JOIN pp_merged p USING (bio_id, i) LEFT JOIN pp_merged q ON q.bio_id = c.bio_id AND q.i < c.i AND c.i <= q.e GROUP BY ALL),
 k AS (SELECT bio_id, min(start_char) AS a, max(start_char + length(replacement)) FILTER (rn <= 3) AS b FROM (SELECT *, row_number() OVER (PARTITION BY bio_id ORDER BY start_char) AS rn FROM log WHERE original <> replacement) GROUP BY 1)
 SELECT bio_id, CASE WHEN a > 70 THEN '…' ELSE '' END || substr(t, greatest(0, a - 70) + 1, least(length(t), b + 70) - greatest(0, a - 70)) || CASE WHEN b + 70 < length(t) THEN '…' ELSE '' END AS context FROM k JOIN n USING (bio_id)""".replace("GROUP BY ALL),", "GROUP BY c.bio_id),").replace("SELECT bio_id, string_agg(CASE WHEN p.i", "SELECT c.bio_id, string_agg(CASE WHEN p.i").replace("LEFT JOIN pp_merged p USING (bio_id, i)", "LEFT JOIN pp_merged p ON p.bio_id = c.bio_id AND p.i = c.i")))
def _(t):
    d = _merged(t).drop("text").withColumnRenamed("new_text", "text")
    return G.change_context(d).select("bio_id", "context")


@query("detect_subject_gender", V("cf", f"""SELECT bio_id, CASE WHEN f > m THEN 'F' WHEN m > f THEN 'M' END AS detected FROM (SELECT bio_id, len(list_filter(w, lambda x: x IN {_sqlist(R.FEMALE_PRONOUNS)})) AS f,
 len(list_filter(w, lambda x: x IN {_sqlist(R.MALE_PRONOUNS)})) AS m FROM (SELECT bio_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM cf))"""))
def _(t):
    return G.detect_subject_gender(G.pieces(cf_texts(t)))


@query("detect_subject_gender_by_name", V("cf nm_at lexn", f"""SELECT bio_id, CASE WHEN nf > nm THEN 'F' WHEN nm > nf THEN 'M' WHEN f > m THEN 'F' WHEN m > f THEN 'M' END AS detected FROM (
 SELECT cf.bio_id, coalesce(n.nf, 0) AS nf, coalesce(n.nm, 0) AS nm, len(list_filter(w, lambda x: x IN {_sqlist(R.FEMALE_PRONOUNS)})) AS f, len(list_filter(w, lambda x: x IN {_sqlist(R.MALE_PRONOUNS)})) AS m
 FROM (SELECT bio_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM cf) cf LEFT JOIN (SELECT bio_id, count_if(gender = 'F') AS nf, count_if(gender = 'M') AS nm FROM nm_at JOIN lexn USING (name)
  WHERE subject AND NOT titled AND NOT inner_ AND share >= 0.9 GROUP BY 1) n ON n.bio_id = cf.bio_id)"""))
def _(t):
    return G.detect_subject_gender(G.pieces(cf_texts(t)), lexicon(t), min_share=0.9)


@query("counterfactual_report", V("au gaps", """, sd AS (SELECT scorer, median(pool_sd) AS m FROM (SELECT scorer, jd_id, min(pool_sd) AS pool_sd FROM gaps WHERE split = 'dev' GROUP BY 1, 2) GROUP BY 1)
 SELECT scorer, condition, jd_id, count(*) AS n_rows, round(avg(score), 6) AS original, round(avg(pert_score), 6) AS perturbed, round(avg(pert_score - score), 6) AS delta, round(avg((pert_score - score) / m), 6) AS delta_norm,
 round(max((pert_score - score) / m), 6) AS largest FROM
 (SELECT * EXCLUDE (pert_score), CASE WHEN changed = 0 THEN score ELSE pert_score END AS pert_score FROM au) LEFT JOIN sd USING (scorer) GROUP BY 1, 2, 3"""))
def _(t):
    sd = t.scores_long().where("split = 'dev'").groupBy("scorer", "jd_id").agg(F.stddev_samp("score").alias("pool_sd"))
    d = G.counterfactual_report(t.audited(), J.pool_sd_median(sd), ["scorer", "condition", "jd_id", "bio_id"], "bio_gender")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return d.groupBy("scorer", "condition", "jd_id").agg(
        F.count(F.lit(1)).alias("n_rows"), mean("original"), mean("perturbed"), mean("delta"), mean("delta_norm"), F.round(F.max("delta_norm"), 6).alias("largest"))


# ------------------------------------------------------------------ pair table and changed-only scores
def _pair_table(t):
    """Every pooled pair with its original and all seven rewrites of its bio."""
    return H.build_pair_table(t.pairs(), rewrites(t, t.pools()), list(G.CONDITIONS), ORIENTATION)


sql_view("ptab", ("pairs", "rw", "cf"), """SELECT p.jd_id, p.bio_id, 'original' AS condition, false AS changed, 0 AS sign, cf.text FROM pairs p JOIN cf USING (bio_id) UNION ALL
 SELECT p.jd_id, p.bio_id, r.condition, r.n_changes > 0, CASE WHEN r.condition = 'agentic_communal' THEN CASE WHEN a2c >= c2a THEN 1 ELSE -1 END WHEN p.bio_gender = 'M' THEN 1 ELSE -1 END, r.text
 FROM pairs p JOIN rw r ON r.bio_id = p.bio_id""")


@query("build_pair_table", V("ptab", "SELECT jd_id, bio_id, condition, changed, sign FROM ptab"))
def _(t):
    return _pair_table(t).select("jd_id", "bio_id", "condition", "changed", "sign")


@query("score_changed_only", V("ptab qtf bidf cstat", f"""
, pt AS MATERIALIZED (SELECT jd_id, bio_id, condition, sha256(text) AS text_id FROM ptab), tx AS MATERIALIZED (SELECT DISTINCT sha256(text) AS text_id, text FROM ptab),
 ttf AS MATERIALIZED (SELECT text_id, token, count(*) AS tf FROM (SELECT text_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#]*')) AS token FROM tx) WHERE token NOT IN {STOPS} GROUP BY 1, 2),
 tdl AS MATERIALIZED (SELECT text_id, sum(tf) AS dl FROM ttf GROUP BY 1),
 sc AS (SELECT p.jd_id, p.text_id, sum(q.tf * i.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))) AS score FROM (SELECT DISTINCT jd_id, text_id FROM pt) p JOIN qtf q ON q.k = p.jd_id
  JOIN ttf d ON d.text_id = p.text_id AND d.token = q.token JOIN bidf i ON i.token = q.token JOIN tdl l ON l.text_id = p.text_id, cstat c GROUP BY 1, 2)
SELECT jd_id, bio_id, condition, round(coalesce(score, 0), 6) AS score, coalesce(score, 0) > 0 AS nonempty FROM pt LEFT JOIN sc USING (jd_id, text_id)"""))
def _(t):
    table = written(_pair_table(t), "pair-table")
    out = H.score_changed_only(table, cf_texts(t), t.jds(), lexical_scorers(t)["bm25"])
    return out.select("jd_id", "bio_id", "condition", r6("score"), "nonempty")
