"""Counterfactual rewrites of texts with a full change log.

A text is cut into pieces (whitespace runs, word runs, single other characters) whose join restores
it. Each part proposes replacements of piece ranges; parts are merged by priority and the text is
rebuilt. All of this is a narrow projection: no token is ever shuffled. Word classes come from
closed-class word lists and neighbouring words, not from a parser.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import PIECE, find_all, let, match_case, order_hash
from ..sources import rules as R
from ..sources.storage import written
from .fairness import build_pair_table, score_changed_by

PROPOSAL = "struct<start:int,end:int,new:string,kind:string,note:string>"
NO_PROPOSALS = f"array<{PROPOSAL}>"
CHANGE = "struct<kind:string,original:string,replacement:string,start_char:int,end_char:int,note:string,orig_start:int,orig_end:int>"
VERB_HINTS = (*R.AUXILIARIES, *R.CONJUNCTIONS, *R.PREPOSITIONS, *R.PRONOUN_WORDS, *R.DETERMINERS)


def pieces(df: DataFrame, text: str = "text", low: bool = True) -> DataFrame:
    """Add ``p`` (pieces) and, unless left out, ``low`` (lower case). Looking for names needs no ``low``.

    They come out of a one-element generator: filters on rewritten texts stop there and do not
    inline the cutting of the text into every later expression.
    """
    lower = lambda p: [F.transform(p, F.lower).alias("low")] if low else []
    cut = let(find_all(F.col(text), PIECE), lambda p: F.struct(p.alias("p"), *lower(p)))
    return df.select("*", F.explode(F.array(cut)).alias("_c")).select(*df.columns, "_c.*")


def _blank(x: Column) -> Column:
    """Whether a piece is a whitespace run; most are one blank, and no other piece of words sorts before "!"."""
    return F.coalesce((x == " ") | ((x < "!") & x.rlike(r"^\s+$")), F.lit(False))


def _near(arr: str, i: Column, step: int) -> Column:
    """Next (or previous) piece that is not whitespace; NULL at the end of the text."""
    one = F.get(arr, i + step)
    return F.when(_blank(one), F.get(arr, i + 2 * step)).otherwise(one)


def _far(arr: str, i: Column, n: int, step: int = 1) -> list[Column]:
    """The n following (or preceding) pieces, whitespace included (blank pieces match no word)."""
    return [F.get(arr, i + step * k) for k in range(1, n + 1)]


def _is_word(x: Column) -> Column:
    return x.rlike(r"^[\p{L}\p{N}_]+$")


def _isin(x: Column, words: Sequence[str]) -> Column:
    return F.coalesce(x.isin(list(dict.fromkeys(words))), F.lit(False))


def _positions(words: Sequence[str]) -> Column:
    """Indexes of the pieces that are one of ``words`` (lower case)."""
    keep = list(words)
    hits = F.transform("low", lambda x, i: F.when(x.isin(keep), i))
    return F.filter(hits, lambda i: i.isNotNull())


def _proposal(i: Column, new: Column, kind: Column | str, note: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), new.alias("new"), as_col(kind).alias("kind"), as_col(note).alias("note"))


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """Small fixed mapping as a chain of comparisons."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


# ------------------------------------------------------------------------------------ pronouns
def swap_pronouns(swap_titles: bool = True) -> Column:
    """Bidirectional pronoun and title swap, as proposals."""
    simple = {**R.PRONOUNS, **R.TITLES}
    title_like = lambda p: p.rlike(r"^\p{Lu}")

    def one(i):
        low, raw, nxt = F.get("low", i), F.get("p", i), _near("low", i, 1)
        # "her" before a content word is possessive; before a function word, a mark or the end it is an object
        her = F.when(nxt.isNull() | ~_is_word(nxt) | _isin(nxt, (*VERB_HINTS, *R.ADVERBS)), "him").otherwise("his")
        # "his" standing alone becomes "hers"
        his = F.when(nxt.isNull() | ~_is_word(nxt) | _isin(nxt, VERB_HINTS), "hers").otherwise("her")
        target = F.when(low == "her", her).when(low == "his", his).otherwise(_lookup(simple, low))
        is_title = low.isin(list(R.TITLES))
        ok = ~is_title | (title_like(raw) if swap_titles else F.lit(False))
        return F.when(ok, _proposal(i, match_case(raw, target), "pronoun", F.concat(low, F.lit("->"), target)))

    found = F.transform(_positions(["her", "his", *simple]), one)
    return F.array_compact(found)


# ------------------------------------------------------------------------------------- phrases
def _tokens(text: str) -> list[str]:
    import re

    return re.findall(r"\w+|[^\w\s]", text)


def swap_phrases(pairs=R.AFFILIATIONS) -> Column:
    """Phrase rules, longest first, non-overlapping, first-letter case kept, as proposals."""
    directed = []
    for p in pairs:
        cs = bool(p.get("case_sensitive", False))
        directed.append((p["a"], p["b"], cs))
        if p.get("bidirectional", True):
            directed.append((p["b"], p["a"], cs))
    directed = sorted(directed, key=lambda r: -len(_tokens(r[0])))
    firsts = sorted({_tokens(a)[0].lower() for a, _, _ in directed})

    longest = max(len(_tokens(a)) for a, _, _ in directed)

    def ahead(i):
        """The pieces from ``i`` on that are not blank, as many as the longest phrase has; blank ones never follow each other."""
        near = F.transform(F.slice("p", i + 1, 2 * longest - 1), lambda x, j: F.struct((i + j).alias("i"), x.alias("w"), F.lower(x).alias("wl")))
        return F.filter(near, lambda x: ~_blank(x["w"]))

    def match_at(words, rule, rank):
        source, target, cs = rule
        toks = _tokens(source)
        want = F.array(*[F.lit(t if cs else t.lower()) for t in toks])
        ok = F.transform(F.slice(words, 1, len(toks)), lambda x: x["w" if cs else "wl"]) == want
        return F.when(ok, F.struct(
            F.lit(rank).alias("rank"), F.get(words, F.lit(0))["i"].alias("start"), (F.get(words, F.lit(len(toks) - 1))["i"] + 1).alias("end"),
            match_case(F.get(words, F.lit(0))["w"], F.lit(target)).alias("new"), F.lit("affiliation").alias("kind"), F.lit(f"{source} -> {target}").alias("note")))

    found = F.flatten(F.transform(_positions(firsts), lambda i: let(ahead(i), lambda words: F.array(*[match_at(words, r, n) for n, r in enumerate(directed)]))))
    ordered = F.sort_array(F.array_compact(found))
    clash = lambda a, x: F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    empty = F.filter(ordered, lambda x: F.lit(False))
    kept = F.aggregate(ordered, empty, lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))))
    out = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["new"].alias("new"), x["kind"].alias("kind"), x["note"].alias("note")))
    return F.array_sort(out, lambda a, b: a["start"] - b["start"])


# --------------------------------------------------------------------------------------- words
SENTENCE_ENDS = (".", "!", "?")


def rewrite_words(swaps=R.WORD_SWAPS) -> Column:
    """Directed word swaps with guards on neighbouring words, as proposals.

    * never inside a hyphenated compound;
    * verb: not after a determiner, possessive or "'s", and a base or -s form not after a be-form;
      an attributive -ing form needs a determiner or pronoun as its object;
    * passive: not after a be-form and not before "by";
    * idiom: no "to" or particle close behind, and no fixed object (way, life, language);
    * modifier: only between a determiner and a content word.
    """
    sources = [s for s, *_ in swaps]
    if len(set(map(str.lower, sources))) != len(sources):
        raise ValueError("duplicate source word")
    target, direction = {s: t for s, t, *_ in swaps}, {s: d for s, _, d, *_ in swaps}
    having = lambda g: [s for s, _, _, _, gs in swaps if g in gs]
    of_class = lambda c: [s for s, _, _, wc, _ in swaps if wc == c]
    nominal_left = (*R.DETERMINERS, *R.POSSESSIVES, "s", "'", "’")
    object_start = (*R.DETERMINERS, *R.POSSESSIVES, *R.PRONOUN_WORDS)
    function_words = (*VERB_HINTS, *R.POSSESSIVES, *R.ADVERBS)

    def one(i):
        low, raw = F.get("low", i), F.get("p", i)
        prev, nxt = _near("low", i, -1), _near("low", i, 1)
        ahead = _far("low", i, 6)
        open_so_far, reach = F.lit(True), []  # a sentence end stops the look-ahead for idioms
        for x in ahead:
            open_so_far = open_so_far & ~_isin(x, SENTENCE_ENDS)
            reach.append((x, open_so_far))
        any_ahead = lambda words: _any([_isin(x, words) & still for x, still in reach])
        hyphen = _isin(prev, ["-"]) | _isin(nxt, ["-"])
        open_next = nxt.isNotNull() & _is_word(nxt) & ~_isin(nxt, function_words)
        verb_ok = ~_isin(prev, nominal_left) & ~(_isin(prev, R.BE_FORMS) & low.isin("lead", "leads"))
        passive = _isin(prev, R.BE_FORMS) | _isin(nxt, ["by"])
        idiom = _isin(nxt, ["to", *R.PARTICLES]) | any_ahead(["to"]) | any_ahead([*R.FIXED_OBJECTS, *[w + "s" for w in R.FIXED_OBJECTS]])
        attributive = ~_isin(nxt, object_start)
        modifier_ok = _isin(prev, (*R.DETERMINERS, *R.POSSESSIVES)) & open_next
        ok = (
            ~hyphen
            & (~low.isin(of_class("verb")) | verb_ok)
            & (~low.isin(having("passive")) | ~passive)
            & (~low.isin(having("idiom")) | ~idiom)
            & (~low.isin(having("attributive")) | ~attributive)
            & (~low.isin(of_class("modifier")) | modifier_ok)
        )
        new = match_case(raw, _lookup(target, low))
        return F.when(F.coalesce(ok, F.lit(False)), _proposal(i, new, _lookup(direction, low), F.concat(raw, F.lit("->"), _lookup(target, low))))

    return F.array_compact(F.transform(_positions(sources), one))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


# --------------------------------------------------------------------------------------- names
def name_lexicon(counts: DataFrame, min_total: int, extra: DataFrame | None = None) -> DataFrame:
    """(name, gender, share) in lower case from (name, sex, count) rows; F on a tie.

    ``extra`` (label, gender) fills names the counts do not know, with share 1.
    """
    f = F.sum(F.when(F.col("sex") == "F", F.col("count")).otherwise(0))
    t = counts.groupBy("name").agg(f.alias("f"), F.sum("count").alias("total")).where(F.col("total") >= min_total)
    share = F.col("f") / F.col("total")
    base = t.select(F.lower("name").alias("name"), F.when(share >= 0.5, "F").otherwise("M").alias("gender"), F.greatest(share, 1 - share).alias("share"), F.lit(0).alias("_src"))
    if extra is not None:
        base = base.unionByName(extra.select(F.lower("label").alias("name"), "gender", F.lit(1.0).alias("share"), F.lit(1).alias("_src")))
    return base.groupBy("name").agg(F.min(F.struct("_src", "gender", "share")).alias("m")).select("name", "m.gender", "m.share")


def name_pools(
    counts: DataFrame, min_total: int, min_share: float, size: int, second: DataFrame | None = None, second_size: int = 100,
    common_over: int = 5000, exclude=(),
) -> DataFrame:
    """(pool, gender, idx, name, n): replacement names in alphabetical order, the most common ones only.

    The second pool takes (label, gender, n) rows: names of one gender only, one plain word, not
    common in the first source, and not excluded.
    """
    f = F.sum(F.when(F.col("sex") == "F", F.col("count")).otherwise(0))
    t = counts.groupBy("name").agg(f.alias("f"), F.sum("count").alias("total")).withColumn("_s", F.col("f") / F.col("total"))
    strong = t.where(F.col("total") >= min_total).select(
        F.lit("us").alias("pool"), F.explode(F.array(F.struct(F.lit("F").alias("g"), F.col("_s").alias("s")), F.struct(F.lit("M").alias("g"), (1 - F.col("_s")).alias("s")))).alias("x"),
        "name", "total").where(F.col("x.s") >= min_share).select("pool", F.col("x.g").alias("gender"), "name", F.col("total").alias("weight"), F.lit(size).alias("k"))
    cand = strong
    if second is not None:
        single = second.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.min("gender").alias("gender"), F.max("n").alias("n")).where("c = 1")
        common = t.where(F.col("total") >= common_over).select(F.col("name").alias("label"))
        plain = single.where(F.col("label").rlike("^[A-Z][a-z]+$") & ~F.col("label").isin(list(exclude) or [""])).join(common, "label", "left_anti")
        cand = cand.unionByName(plain.select(F.lit("in").alias("pool"), "gender", F.col("label").alias("name"), F.col("n").alias("weight"), F.lit(second_size).alias("k")))
    top = cand.withColumn("_r", F.row_number().over(W.partitionBy("pool", "gender").orderBy(F.desc("weight"), "name"))).where(F.col("_r") <= F.greatest(F.lit(size), F.lit(second_size)))
    top = top.where(F.col("_r") <= F.col("k"))
    by = W.partitionBy("pool", "gender")
    return top.select("pool", "gender", (F.row_number().over(by.orderBy("name")) - 1).cast("bigint").alias("idx"), "name", F.count(F.lit(1)).over(by).alias("n"))


def pick_replacement(names: DataFrame, pools: DataFrame, key: str = "bio_id") -> DataFrame:
    """(key, name, pool, target gender) -> ``replacement``: position sha256(key|name) modulo the pool size."""
    sizes = pools.groupBy("pool", "gender").agg(F.max("n").alias("_n"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "name"), 256), 1, 12), 16, 10).cast("bigint")
    d = names.join(sizes, ["pool", "gender"]).withColumn("idx", h % F.col("_n")).drop("_n")
    return d.join(pools.select("pool", "gender", "idx", F.col("name").alias("replacement")), ["pool", "gender", "idx"]).drop("idx")


def name_candidates(df: DataFrame, key: str = "bio_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """First words of title-case runs that may name the subject: (key, carry, name, titled, surname, subject).

    ``df`` has pieces. A run is a chain of title-case words that are not function words. A run of one
    word, a run at the start of a sentence and a run followed by "'s" or a verb are subject-like.
    """
    # no upper-case letter sorts before "A" or among the small ASCII letters: most pieces never meet the pattern
    cap = lambda x: (x >= "A") & ~((x >= "a") & (x < "{")) & x.rlike(r"^\p{Lu}\p{Ll}+$") & ~F.lower(x).isin(list(R.STOP_WORDS))
    low = lambda i: F.lower(F.get("p", i))
    near = lambda i, step: F.lower(_near("p", i, step))
    title_before = lambda i: F.coalesce(
        _isin(near(i, -1), R.NAME_TITLES) | ((near(i, -1) == ".") & _isin(low(F.when(_blank(F.get("p", i - 1)), i - 3).otherwise(i - 2)), R.NAME_TITLES)), F.lit(False))
    on = lambda i: F.coalesce(cap(F.get("p", i)), F.lit(False))
    # neighbours inside a run are exactly one blank piece apart
    joined = lambda i, step: on(i + 2 * step) & _blank(F.get("p", i + step))
    verb_like = (*R.AUXILIARIES, "s")

    def info(i):
        nxt, prev = near(i, 1), near(i, -1)
        # the word after the whole run, for runs of two and three words
        after2, after3 = low(i + 4), low(i + 6)
        alone = ~joined(i, 1) & ~joined(i, -1)
        starts = prev.isNull() | prev.isin(".", "!", "?")
        poss = nxt.isin("'", "’")
        verb = _isin(after2, verb_like) | after2.rlike("^[a-z]+s$") | _isin(after3, verb_like)
        return F.struct(
            i.alias("i"), low(i).alias("name"), title_before(i).alias("titled"), (joined(i, -1) & ~title_before(i - 2)).alias("inner"),
            (joined(i, -1) & ~joined(i, 1)).alias("surname"), F.coalesce(alone | (starts & ~joined(i, -1)) | poss | (joined(i, 1) & verb), F.lit(False)).alias("subject"), alone.alias("alone"))

    at = F.filter(F.transform("p", lambda x, i: F.when(cap(x), i)), lambda i: i.isNotNull())
    return df.select(key, *carry, F.explode(F.transform(at, info)).alias("x")).select(key, *carry, "x.*")


def subject_names(
    df: DataFrame, lexicon: DataFrame, min_share: float = 0.95, subject_only: bool = True, key: str = "bio_id", gender: str = "gender"
) -> DataFrame:
    """(key, name, own): strongly gendered first names of the text's own gender that name its subject.

    Only the few title-case words leave the row, with the text's gender: they meet the lexicon by
    equi-join, and the texts are cut once.
    """
    c = name_candidates(df, key, (gender,)).join(lexicon.where(F.col("share") >= min_share).select("name", F.col("gender").alias("_g")), "name")
    per_name = c.groupBy(key, "name").agg(
        F.max("surname").alias("surname"), F.max("subject").alias("subject"), F.first("_g").alias("_g"), F.first(gender).alias("own"),
        F.max(~F.col("titled") & ~F.col("inner") & ~F.col("alone")).alias("head"), F.max(~F.col("titled") & F.col("alone")).alias("alone"))
    usable = (F.col("head") | (F.col("alone") & ~F.col("surname"))) & (F.col("subject") if subject_only else F.lit(True))
    return per_name.where(usable).where("_g = own").select(key, "name", "own")


def replacement_maps(names: DataFrame, pools: DataFrame, targets: list[tuple[str, str]], key: str = "bio_id") -> DataFrame:
    """(key, one map column ``<pool>_<target>`` per target): lower-case first name -> replacement."""
    if any(t not in ("opposite", "same") for _, t in targets):
        raise ValueError("target must be 'opposite' or 'same'")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(t).alias("target")) for p, t in targets]))
    other = F.when(F.col("own") == "F", "M").otherwise("F")
    want = names.select(key, "name", "own", each.alias("x")).select(
        key, "name", "x.pool", "x.target", F.when(F.col("x.target") == "same", F.col("own")).otherwise(other).alias("gender"))
    picks = pick_replacement(want, pools, key)
    entry = F.struct("name", "replacement")
    cols = [F.map_from_entries(F.collect_list(F.when((F.col("pool") == p) & (F.col("target") == t), entry))).alias(f"{p}_{t}") for p, t in targets]
    return picks.groupBy(key).agg(*cols)


def swap_names(
    df: DataFrame, lexicon: DataFrame, pools: DataFrame, pool: str, target: str, min_share: float = 0.95, subject_only: bool = True,
    key: str = "bio_id", gender: str = "gender",
) -> DataFrame:
    """(key, names): map of lower-case first name -> replacement for each text that has one."""
    names = subject_names(df, lexicon, min_share, subject_only, key, gender)
    return replacement_maps(names, pools, [(pool, target)], key).select(key, F.col(f"{pool}_{target}").alias("names"))


def name_proposals(names: str, note: Column | str) -> Column:
    """Proposals for every untitled title-case mention of a mapped name."""
    def one(i):
        low, raw, prev = F.get("low", i), F.get("p", i), _near("low", i, -1)
        before = F.get("low", F.when(_blank(F.get("low", i - 1)), i - 3).otherwise(i - 2))
        titled = _isin(prev, R.NAME_TITLES) | (F.coalesce(prev == ".", F.lit(False)) & _isin(before, R.NAME_TITLES))
        return F.when(raw.rlike(r"^\p{Lu}\p{Ll}+$") & ~titled, _proposal(i, match_case(raw, F.element_at(names, low)), "name", note))

    at = F.filter(F.transform("low", lambda x, i: F.when(F.map_contains_key(names, x), i)), lambda i: i.isNotNull())
    return F.when(F.col(names).isNull(), F.array().cast(NO_PROPOSALS)).otherwise(F.array_compact(F.transform(at, one)))


def detect_subject_gender(df: DataFrame, lexicon: DataFrame | None = None, key: str = "bio_id", min_share: float = 0.95) -> DataFrame:
    """(key, detected): strongly gendered first names decide, else the pronoun majority, else NULL."""
    n = lambda words: F.size(F.filter("low", lambda x: x.isin(list(words))))
    base = df.select(key, n(R.FEMALE_PRONOUNS).alias("pf"), n(R.MALE_PRONOUNS).alias("pm"))
    if lexicon is not None:
        c = name_candidates(df, key).where("subject AND NOT titled AND NOT inner").join(
            lexicon.where(F.col("share") >= min_share).select("name", F.col("gender").alias("_g")), "name")
        counts = c.groupBy(key).agg(F.count_if(F.col("_g") == "F").alias("nf"), F.count_if(F.col("_g") == "M").alias("nm"))
        base = base.join(counts, key, "left").na.fill(0, ["nf", "nm"])
    else:
        base = base.withColumns({"nf": F.lit(0), "nm": F.lit(0)})
    return base.select(key, F.when(F.col("nf") > F.col("nm"), "F").when(F.col("nm") > F.col("nf"), "M")
                       .when(F.col("pf") > F.col("pm"), "F").when(F.col("pm") > F.col("pf"), "M").alias("detected"))


# ---------------------------------------------------------------------------- merge and rebuild
def merge_proposals(parts: list[Column]) -> Column:
    """Accepted proposals in text order. An earlier part wins over any later one it overlaps.

    Every part is free of overlaps in itself, so a later proposal is only compared with the accepted
    ones of the parts before it.
    """
    kept = parts[0]
    for p in parts[1:]:
        kept = let(kept, lambda k: F.concat(k, _without_overlap(p, k)))
    return F.sort_array(kept)


def _without_overlap(later: Column, accepted: Column) -> Column:
    return F.filter(later, lambda x: ~F.exists(accepted, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))


def apply_proposals(df: DataFrame, proposals: str, text: str = "text") -> DataFrame:
    """Add ``new_text``, ``changes`` (offsets in both texts), ``changed`` and ``n_changes``.

    ``df`` has pieces and a column of merged proposals.
    """
    d = df.withColumn("_r", _rebuilt(F.col(proposals), text))
    return d.select(*df.columns, F.col("_r.text").alias("new_text"), F.col("_r.changes").alias("changes"), F.size("_r.changes").alias("n_changes"), (F.size("_r.changes") > 0).alias("changed"))


def _rebuilt(proposals: Column, text: str) -> Column:
    """(text, changes) of a row with pieces after its merged proposals.

    The text between two accepted proposals is joined once; offsets are running sums over the few
    changes of the text.
    """
    cut = lambda a, b: F.array_join(F.slice("p", a + 1, b - a), "")
    n = F.length

    def segments(c):
        prev = lambda i: F.coalesce(F.get(c, i - 1)["end"], F.lit(0))
        return F.struct(F.transform(c, lambda x, i: F.struct(
            cut(prev(i), x["start"]).alias("gap"), cut(x["start"], x["end"]).alias("old"), x["new"].alias("new"), x["kind"].alias("kind"), x["note"].alias("note"))).alias("g"),
            F.coalesce(F.get(c, F.size(c) - 1)["end"], F.lit(0)).alias("last"))

    def result(s):
        # running offsets: positions of each change in the old and in the new text
        init = F.struct(F.lit(0).alias("o"), F.lit(0).alias("n"), F.array().cast("array<struct<o:int,n:int>>").alias("at"))
        at = F.aggregate(s["g"], init, lambda a, x: F.struct(
            (a["o"] + n(x["gap"]) + n(x["old"])).alias("o"), (a["n"] + n(x["gap"]) + n(x["new"])).alias("n"),
            F.concat(a["at"], F.array(F.struct((a["o"] + n(x["gap"])).alias("o"), (a["n"] + n(x["gap"])).alias("n")))).alias("at")), lambda a: a["at"])
        log = F.transform(F.arrays_zip(s["g"].alias("g"), at.alias("at")), lambda z: F.struct(
            z["g"]["kind"].alias("kind"), z["g"]["old"].alias("original"), z["g"]["new"].alias("replacement"), z["at"]["n"].alias("start_char"),
            (z["at"]["n"] + n(z["g"]["new"])).alias("end_char"), z["g"]["note"].alias("note"), z["at"]["o"].alias("orig_start"),
            (z["at"]["o"] + n(z["g"]["old"])).alias("orig_end")))
        rebuilt = F.concat(F.array_join(F.transform(s["g"], lambda x: F.concat(x["gap"], x["new"])), ""), cut(s["last"], F.size("p")))
        return F.struct(F.when(F.size(s["g"]) == 0, F.col(text)).otherwise(rebuilt).alias("text"), F.filter(log, lambda x: x["original"] != x["replacement"]).alias("changes"))

    return let(F.struct(proposals.alias("c")), lambda c: let(segments(c["c"]), result))


# ---------------------------------------------------------------------------------- conditions
CONDITIONS = {
    "pronoun_swap": ("pronoun",), "name_swap_us": ("name_us_opposite",), "name_swap_in": ("name_in_opposite",), "name_in_same_gender": ("name_in_same",),
    "affiliation_swap": ("affiliation",), "agentic_communal": ("agentic_communal",), "gender_full": ("pronoun", "name_us_opposite"),
}


def generate_conditions(
    bios: DataFrame, lexicon: DataFrame, pools: DataFrame, conditions: dict[str, tuple[str, ...]] = CONDITIONS, key: str = "bio_id", text: str = "text",
    gender: str = "gender", min_share: float = 0.95, subject_only: bool = True, affiliations=R.AFFILIATIONS, swaps=R.WORD_SWAPS, swap_titles: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (bio, condition): text, changed, n_changes, changes, and the columns in ``carry``.

    Every part's proposals are computed once per bio; conditions only merge and rebuild. They do so
    before they become rows, so the pieces are not copied for each of them.
    """
    known = {"pronoun", "affiliation", "agentic_communal", *[f"name_{p}_{t}" for p in ("us", "in") for t in ("opposite", "same")]}
    used = list(dict.fromkeys(p for ps in conditions.values() for p in ps))
    bad = [p for p in used if p not in known]
    if bad:
        raise ValueError(f"unknown parts {bad}")
    d = bios
    targets = [tuple(p.removeprefix("name_").split("_")) for p in used if p.startswith("name_")]
    if targets:
        # the maps are joined to the plain texts, so that no array of pieces is ever shuffled
        names = subject_names(pieces(bios, text, low=False), lexicon, min_share, subject_only, key, gender)
        d = d.join(replacement_maps(names, pools, targets, key).withColumnsRenamed({f"{p}_{t}": f"_m_name_{p}_{t}" for p, t in targets}), key, "left")
    d = pieces(d, text)
    for part in used:
        if part == "pronoun":
            col = swap_pronouns(swap_titles)
        elif part == "affiliation":
            col = swap_phrases(affiliations)
        elif part == "agentic_communal":
            col = rewrite_words(swaps)
        else:
            col = name_proposals(f"_m_{part}", part.removeprefix("name_"))
        d = d.withColumn(f"_p_{part}", col)
    merged = F.array(*[
        F.struct(F.lit(name).alias("condition"), merge_proposals([F.col(f"_p_{p}") for p in parts]).alias("props")) for name, parts in conditions.items()])
    done = F.transform(merged, lambda c: F.struct(c["condition"].alias("condition"), _rebuilt(c["props"], text).alias("r")))
    rows = d.select(key, gender, *carry, F.explode_outer(done).alias("c")).select(key, gender, *carry, "c.condition", "c.r.text", "c.r.changes")
    return rows.select(key, gender, *carry, "condition", F.col("text"), (F.size("changes") > 0).alias("changed"), F.size("changes").alias("n_changes"), "changes")


def perturbation_coverage(rewrites: DataFrame, by: list[str], gender: str = "gender") -> DataFrame:
    """Per group and condition: bios, % changed (all, F, M) and mean changes of the changed ones."""
    c = F.col("changed").cast("int") * 100
    return rewrites.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bios"), F.avg(c).alias("pct_changed"), F.avg(F.when(F.col(gender) == "F", c)).alias("pct_changed_f"),
        F.avg(F.when(F.col(gender) == "M", c)).alias("pct_changed_m"), F.avg(F.when(F.col("changed"), F.col("n_changes"))).alias("mean_changes"))


def qa_samples(rewrites: DataFrame, n: int, seed: int, key: str = "bio_id") -> DataFrame:
    """A seeded sample of n changed rows per condition, with the new spans in bold."""
    d = rewrites.where("changed").withColumn("_h", order_hash(seed, "condition", key))
    top = d.withColumn("_r", F.row_number().over(W.partitionBy("condition").orderBy("_h"))).where(F.col("_r") <= n)
    prev = lambda i: F.coalesce(F.get("changes", i - 1)["end_char"], F.lit(0))
    sub = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    bold = F.array_join(F.transform("changes", lambda c, i: F.concat(sub(prev(i), c["start_char"]), F.lit("**"), c["replacement"], F.lit("**"))), "")
    last = F.get("changes", F.size("changes") - 1)["end_char"]
    return top.select("condition", F.col("_r").cast("bigint").alias("sample"), key, F.concat(bold, sub(last, F.length("text"))).alias("marked"))


def change_context(rewrites: DataFrame, window: int = 70, first: int = 3) -> DataFrame:
    """Add ``context``: the text around the first changes, with ellipses where it is cut."""
    lo = F.greatest(F.lit(0), F.get("changes", F.lit(0))["start_char"] - window)
    hi = F.least(F.length("text"), F.get("changes", F.least(F.size("changes"), F.lit(first)) - 1)["end_char"] + window)
    cut = F.substring(F.col("text"), lo + 1, hi - lo)
    return rewrites.where("changed").withColumn(
        "context", F.concat(F.when(lo > 0, "…").otherwise(""), cut, F.when(hi < F.length("text"), "…").otherwise("")))


def counterfactual_report(
    scored: DataFrame, pool_sd: DataFrame, by: list[str], gender: str | None = None, conditions: dict[str, tuple[str, ...]] = CONDITIONS,
) -> DataFrame:
    """Per text, condition and scorer: original, rewritten, delta, and delta in median pool SDs.

    A rewrite that is not ``changed`` has the score of its original. ``gender`` names the column of the
    subject's gender: where it is NULL, conditions of name parts alone are ``skipped``, with the reason and
    without scores. A scorer without a median keeps its rows. There is one median per scorer. It is
    broadcast: a shuffle by scorer would bring the rows of each scorer into one task.
    """
    d = scored.join(F.broadcast(pool_sd.select("scorer", "pool_sd_median")), "scorer", "left")
    same = ~F.col("changed").cast("boolean") if "changed" in scored.columns else F.lit(False)
    names_only = [c for c, parts in conditions.items() if all(p.startswith("name_") for p in parts)]
    skip = F.col(gender).isNull() & F.col("condition").isin(names_only) if gender else F.lit(False)
    d = d.select(*by, *(["changed"] if "changed" in scored.columns and "changed" not in by else []), "pool_sd_median", skip.alias("_skip"),
                 F.when(~skip, F.col("score")).alias("original"), F.when(~skip, F.when(same, F.col("score")).otherwise(F.col("pert_score"))).alias("perturbed"))
    delta = F.col("perturbed") - F.col("original")
    reason = [F.when(F.col("_skip"), "no gendered first name or pronouns found").alias("skipped")] if gender else []
    return d.select(
        *[c for c in d.columns if c not in ("_skip", "pool_sd_median")], delta.alias("delta"), (delta / F.nullif(F.col("pool_sd_median"), F.lit(0.0))).alias("delta_norm"), *reason)


def counterfactual_check(
    bios: DataFrame, jds: DataFrame, pairs: DataFrame, lexicon: DataFrame, pools: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], pool_sd: DataFrame,
    conditions: dict[str, tuple[str, ...]] = CONDITIONS, min_share: float = 0.95,
) -> DataFrame:
    """``counterfactual_report`` of the texts themselves, for (jd_id, bio_id) pairs, with the changes made.

    The gender of a text's subject is detected, name parts apply where it is known, and each scorer
    scores the originals and the changed rewrites.
    """
    found = detect_subject_gender(pieces(bios.select("bio_id", "text")), lexicon, min_share=min_share)
    texts = written(bios.select("bio_id", "text").join(found.withColumnRenamed("detected", "gender"), "bio_id"), "detected")
    rewrites = written(generate_conditions(texts, lexicon, pools, conditions, min_share=min_share), "rewrites")
    pool = pairs.select("jd_id", "bio_id").join(texts.select("bio_id", F.col("gender").alias("bio_gender")), "bio_id")
    table = written(build_pair_table(pool, rewrites, list(conditions), {"default": "gender"}), "pairs")
    scores = written(score_changed_by(table, texts, jds, scorers), "text-scores")
    key = ["scorer", "jd_id", "bio_id"]
    first = scores.where("condition = 'original'").select(*key, "score")
    after = scores.where("condition <> 'original'").select(*key, "condition", "changed", F.col("score").alias("pert_score"))
    log = rewrites.select("bio_id", "condition", "gender", F.col("text").alias("perturbed_text"), "changes")
    rows = after.join(first, key).join(log, ["bio_id", "condition"])
    return counterfactual_report(rows, pool_sd, [*key, "condition", "gender", "perturbed_text", "changes"], "gender", conditions)
