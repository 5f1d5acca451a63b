"""Quality rules combined by weak supervision, with column functions only.

Every rule looks at one count of a text and votes good (1) or bad (-1), or abstains (0) between its
two limits. A rule has two accuracies, one for good and one for bad documents; they and the share of
good documents are estimated without labels by expectation-maximisation (``ROUNDS`` steps) over the
table of vote patterns, which has at most 3 ** (number of rules) rows however large the corpus.
Abstentions say nothing. ``PRIOR`` imaginary votes per rule and class keep the estimates inside (0, 1),
and the start tells which side is good: one failed rule is not yet proof of a bad document, two are. A document is kept if the posterior probability of good is at least
``ACCEPT`` and it passes the base rules.

Whole texts are counted, in the row: three-word windows are numbered by hashes packed with their
places into one long each and sorted; neighbours in that order are compared word by word, so a window
counts as repeated only if it is. (Two different windows whose hashes agree in the bits left beside the
place, 64 less the bits of the word count, hide a repetition only if one stands between two others.)

A null or empty text has no words, fails the base rules and gets no votes. Repeated rows and ids are
judged one by one and count as often as they occur. An empty table gives an empty result. Columns
other than id and text are not read by ``judged``; ``passing`` returns them as they are, whatever
their names, and needs ids only to carry them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
ROUNDS = 15
ACCEPT = 0.5
#: Where the estimation starts: good documents fail few rules, bad ones fail some, since junk is of several kinds.
START = {"good": 0.8, "right": 0.98, "found": 0.3}
PRIOR = 10.0  # imaginary votes per rule and class, and documents, divided as in START

#: name: (vote good if, vote bad if), in whole numbers so that every engine agrees.
RULES = {
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "signs": ("8 * n_signs <= word_chars", "6 * n_signs > word_chars"),
    "bare": ("50 * n_bare <= n_words", "5 * n_bare > n_words"),
    "repeats": ("20 * n_repeat_words <= 3 * n_words", "3 * n_repeat_words > n_words"),
    "lines": ("n_lines > 2 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "capitals": ("n_upper > 0 and 6 * n_upper <= word_chars", "2 * n_upper > word_chars - n_signs"),
    "length": ("word_chars >= 3 * n_words and word_chars <= 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "short": ("5 * n_short >= n_words", "20 * n_short < n_words"),
    "ends": ("50 * n_ends >= n_words and 4 * n_ends <= n_words", "2 * n_ends > n_words or 200 * n_ends < n_words"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_signs", "n_bare", "n_short", "n_ends")
UPPER = r"\p{Lu}"
SIGN = r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D]"  # neither letter nor digit nor blank
BARE = rf"(?={SIGN})(?<![^\x20\x09-\x0D]){SIGN}++(?![^\x20\x09-\x0D])"  # a word of such signs alone
ENDS = r"[.!?](?![^\x20\x09-\x0D])"
BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in the array."""
    last = F.size(words) - window

    def with_keys(hashes: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words).cast("long")))) - 1
        return _let(low, lambda mask: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(window)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def repeated(keys: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words).cast("long")))) - 1

        def with_mask(mask: Column) -> Column:
            place = lambda key: key.bitwiseAND(mask).cast("int")

            def same(key: Column, other: Column) -> Column:
                near = key.bitwiseXOR(other).bitwiseAND(F.bitwise_not(mask)) == 0
                for j in range(window):
                    near = near & (F.get(words, place(key) + j) == F.get(words, place(other) + j))
                return F.coalesce(near, F.lit(False))

            first = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda k: same(F.get(keys, k), F.get(keys, k + 1)))
            both = F.flatten(F.transform(first, lambda k: F.array(place(F.get(keys, k)), place(F.get(keys, k + 1)))))
            return F.sort_array(F.array_distinct(both))

        return _let(low, with_mask)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = _let(hashes, with_keys)
    places = _let(F.sort_array(keys), repeated)
    return F.when(last >= 0, _let(places, covered)).otherwise(F.lit(0).cast("long"))


def _of_words(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.char_length(w) <= 3)).cast("long").alias("n_short"),
    )


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``COUNTS`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    number = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id",
        _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _of_words).alias("w"),
        _let(lines, _of_lines).alias("l"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        *[number(pattern).alias(name) for name, pattern in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_signs", SIGN), ("n_bare", BARE), ("n_ends", ENDS))],
    )
    return rows.select("*", "w.*", "l.*").select("id", *COUNTS)


def vote(good: str, bad: str) -> str:
    """SQL of a rule's vote."""
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def votes() -> Column:
    """The votes of all rules as an array, from the counts."""
    return F.array(*[F.expr(vote(*limits)) for limits in RULES.values()]).alias("votes")


def posterior(model: dict) -> Column:
    """Probability of good from the array of votes.

    The weights are one array literal, so that the generated code is the same in every step.
    """
    weights = [0.0] * (3 * len(RULES)) + [math.log(model["good"] / (1 - model["good"]))]
    for j, rule in enumerate(RULES):
        right, found = model["right"][rule], model["found"][rule]
        weights[3 * j], weights[3 * j + 2] = math.log((1 - right) / found), math.log(right / (1 - found))
    odds = F.get(F.lit(weights), F.size("votes") * 3)
    for j in range(len(RULES)):
        odds = odds + F.get(F.lit(weights), F.get("votes", F.lit(j)) + (3 * j + 1))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(judgements: DataFrame) -> dict:
    """``good``: the share of good documents; ``right`` and ``found``: the accuracies of each rule.

    ``right``: share of good documents, of those it votes on, that a rule calls good; ``found``: share of
    bad ones that it calls bad. Each step is an aggregate over the vote patterns, and only the sums of
    each rule and vote come back.
    """
    patterns = Scratch(judgements.sparkSession, "votes").write(judgements.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")  # 3 ** rules rows at most
    patterns = patterns.coalesce(1)  # one partition, so the steps need no exchange
    model = {"good": START["good"], "right": dict.fromkeys(RULES, START["right"]), "found": dict.fromkeys(RULES, START["found"])}
    share = lambda hit, miss, kind: (hit + PRIOR * START[kind]) / (hit + miss + PRIOR)
    for _ in range(ROUNDS):
        d = patterns.select("n", (F.col("n") * posterior(model)).alias("g"), F.posexplode("votes").alias("rule", "vote"))
        sums = {(r["rule"], r["vote"]): (r["g"], r["n"] - r["g"]) for r in d.groupBy("rule", "vote").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()}  # three rows a rule
        of = lambda j, v, bad: sums.get((j, v), (0.0, 0.0))[bad]
        good, bad = (sum(of(0, v, side) for v in (-1, 0, 1)) for side in (0, 1))
        model = {
            "good": share(good, bad, "good"),
            "right": {rule: share(of(j, 1, 0), of(j, -1, 0), "right") for j, rule in enumerate(RULES)},
            "found": {rule: share(of(j, -1, 1), of(j, 1, 1), "found") for j, rule in enumerate(RULES)},
        }
    return model


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, <COUNTS>, votes, base_failed, quality, kept`` of every row; texts are read once."""
    counts = Scratch(docs.sparkSession, "rules").write(counted(docs, id_col, text_col), "counts").select("*", votes())
    out = counts.withColumns({"base_failed": F.expr(BASE_FAILED), "quality": posterior(estimate(counts.select("votes")))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= ACCEPT))


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; the texts are counted twice rather than moved to a join."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id")
    counts = counted(docs.select(whole, F.col(f"`{text_col}`").alias("text")), "id", "text")
    model = estimate(counts.select(votes()))
    out = counts.select("id", F.expr(BASE_FAILED).alias("base_failed"), votes())
    return out.where(~F.col("base_failed") & (posterior(model) >= ACCEPT)).select("id.*")


def rule_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality`` (six digits)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs, id_col, text_col).select(F.col("id").alias(id_col), *names, F.round("quality", 6).alias("quality"))


def _odds_sql(model: str) -> str:
    parts = [f"ln({model}.good / (1 - {model}.good))"]
    for rule in RULES:
        right, found = f"{model}.right_{rule}", f"{model}.found_{rule}"
        parts.append(f"CASE vote_{rule} WHEN 1 THEN ln({right} / (1 - {found})) WHEN -1 THEN ln((1 - {right}) / {found}) ELSE 0 END")
    return f"(1 / (1 + exp(-({' + '.join(parts)}))))"


def rule_sql() -> str:
    """The rows of ``rule_report`` over the documents."""
    each = ", ".join(f"{vote(*limits)} AS vote_{rule}" for rule, limits in RULES.items())
    names = ", ".join(f"vote_{rule}" for rule in RULES)
    steps = [f"m0 AS MATERIALIZED (SELECT {START['good']}::double AS good, " + ", ".join(f"{START[kind]}::double AS {kind}_{rule}" for rule in RULES for kind in ("right", "found")) + ")"]
    for r in range(ROUNDS):
        sums = [f"(sum(n * p) + {PRIOR * START['good']}) / (sum(n) + {PRIOR}) AS good"]
        for rule in RULES:
            v = f"vote_{rule}"
            sums.append(f"(sum(CASE WHEN {v} = 1 THEN n * p ELSE 0 END) + {PRIOR * START['right']}) / (sum(CASE WHEN {v} <> 0 THEN n * p ELSE 0 END) + {PRIOR}) AS right_{rule}")
            sums.append(f"(sum(CASE WHEN {v} = -1 THEN n * (1 - p) ELSE 0 END) + {PRIOR * START['found']}) / (sum(CASE WHEN {v} <> 0 THEN n * (1 - p) ELSE 0 END) + {PRIOR}) AS found_{rule}")
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT pat.*, {_odds_sql('m')} AS p FROM pat, m{r} m))")
    word = WORD.replace("'", "''")
    return (
        f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
p AS (SELECT rn, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
g AS MATERIALIZED (SELECT p.rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM p JOIN d USING (rn)),
r AS (SELECT rn, i FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM g) WHERE c > 1),
rep AS MATERIALIZED (SELECT rn, sum(least(3, coalesce(nxt - i, 3)))::bigint AS n FROM (SELECT *, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM r) GROUP BY 1),
l AS MATERIALIZED (SELECT rn, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
c AS MATERIALIZED (SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
  len(regexp_extract_all(text, '{SYMBOL}'))::bigint AS n_symbols, (len(l.l) - len(list_distinct(l.l)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words,
  len(l.l) AS n_lines, len(regexp_extract_all(text, '{UPPER}')) AS n_upper, len(regexp_extract_all(text, '{SIGN}')) AS n_signs,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}\\p{{M}}]'))) AS n_bare, len(list_filter(w, lambda x: length(x) <= 3)) AS n_short, len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends
  FROM d JOIN l USING (rn) LEFT JOIN rep USING (rn)),
v AS MATERIALIZED (SELECT *, {each} FROM c),
pat AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
""" + ",\n".join(steps) + f""",
q AS (SELECT v.*, {BASE_FAILED} AS base_failed, {_odds_sql('m')} AS p FROM v, m{ROUNDS} m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {ACCEPT} AS kept, round(p, 6) AS quality FROM q"""
    )
