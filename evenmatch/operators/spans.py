"""Typed spans: dictionary matching, overlap resolution, merging, BIO tags, entities.

A span table has one row per span: a document key, ``start``, ``end`` (exclusive token positions),
``text``, ``label``, ``source`` and optionally ``concept_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import WORD_OR_MARK, find_all, let, light_stems
from ..sources.rules import STOP_WORDS

BIN = 64  # token positions per bin of the interval joins


def runs(flags: Column) -> Column:
    """Maximal runs of true flags as array<struct<start, end>>. ``flags`` must be a plain column."""
    # only the true positions are looked at twice
    at = F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    alone = lambda a, i, k, step: ~F.coalesce(F.get(a, k + step) == i + step, F.lit(False))
    found = let(at, lambda a: F.arrays_zip(
        F.filter(a, lambda i, k: alone(a, i, k, -1)).alias("start"), F.filter(a, lambda i, k: alone(a, i, k, 1)).alias("end")))
    return F.transform(found, lambda z: F.struct(z["start"].cast("bigint").alias("start"), (z["end"] + 1).cast("bigint").alias("end")))


# -------------------------------------------------------------------------------- dictionary
def build_patterns(
    forms: DataFrame, min_chars: int = 2, max_tokens: int = 8, stop_words=STOP_WORDS, exclude=(), drop_stop_only: bool = True
) -> DataFrame:
    """One row per case-folded surface form; the first concept and form in file order wins."""
    words = F.filter(F.split(F.lower("form"), r"\s+"), lambda w: F.length(w) > 0)
    ok = (F.length("form") >= min_chars) & (F.size(words) <= max_tokens)
    if exclude:
        ok = ok & ~F.lower("form").isin([e.lower() for e in exclude])
    if drop_stop_only:
        ok = ok & ~F.forall(words, lambda w: w.isin(sorted(stop_words)))
    return (
        forms.where(ok)
        .groupBy(F.lower("form").alias("key"))
        .agg(F.min(F.struct("concept_pos", "form_pos", "label", "form", "concept_id")).alias("m"))
        .select("key", "m.label", "m.form", "m.concept_id", "m.concept_pos", "m.form_pos")
    )


def _token_keys(col: Column, mode: str) -> Column:
    toks = find_all(F.lower(col), WORD_OR_MARK)
    return light_stems(toks) if mode == "norm" else toks


def dictionary_spans(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "norm") -> DataFrame:
    """All phrase matches, one row per (document, start, end), for patterns of any length.

    Every position is probed by the hash of its first token and that of its first two tokens: patterns
    of one token are found by the former, longer ones by the latter, so frequent first words alone
    lead nowhere. Only positions and lengths that a probe named are cut out of the text and compared
    with the pattern keys; a row never carries more words than the pattern it may match. Spark
    broadcasts the pattern table when it is small and shuffles by probe and n-gram otherwise.
    ``norm`` compares light stems, ``lower`` folded tokens; what the latter finds the former finds too.
    """
    pats = (
        patterns.withColumn("_p", _token_keys(F.col("form"), mode))
        .groupBy(F.array_join("_p", " ").alias("_k"), F.slice("_p", 1, 2).alias("_head"), F.size("_p").alias("_len"))
        .agg(F.min(F.struct("concept_pos", "form_pos", "label", "concept_id")).alias("m"))
        .select("_k", "_head", "_len", "m.label", "m.concept_id")
    )
    two = lambda a, b: F.xxhash64(F.xxhash64(a), F.xxhash64(b))
    heads = pats.select(F.when(F.size("_head") == 1, F.xxhash64(F.get("_head", F.lit(0)))).otherwise(two(F.get("_head", F.lit(0)), F.get("_head", F.lit(1)))).alias("_probe"), "_len")
    lengths = heads.groupBy("_probe").agg(F.collect_set("_len").alias("_lens"))
    toks = docs.select(key, find_all(F.col(text), WORD_OR_MARK).alias("_t"), _token_keys(F.col(text), mode).alias("_n"))
    ones = F.transform("_n", lambda x, i: F.struct(i.alias("start"), F.xxhash64(x).alias("_probe")))
    twos = F.transform("_n", lambda x, i: F.struct(i.alias("start"), two(x, F.get("_n", i + 1)).alias("_probe")))
    probes = toks.select(key, F.explode_outer(F.concat(ones, twos)).alias("g")).where("g IS NOT NULL").select(key, "g.*")
    hits = probes.join(lengths, "_probe").select(key, F.explode("_lens").alias("_len"), "start").groupBy(key).agg(F.collect_set(F.struct("start", F.col("_len").alias("n"))).alias("_at"))
    cut = lambda words, at: F.array_join(F.slice(words, at["start"] + 1, at["n"]), " ")
    found = F.transform(F.filter("_at", lambda at: at["start"] + at["n"] <= F.size("_n")), lambda at: F.struct(
        at["start"].alias("start"), at["n"].alias("n"), cut("_n", at).alias("_k"), cut("_t", at).alias("text")))
    return (
        toks.join(hits, key).select(key, F.explode_outer(found).alias("g")).where("g IS NOT NULL").select(key, "g.*")
        .join(pats.select("_k", "label", "concept_id"), "_k")
        .select(key, F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("n")).cast("bigint").alias("end"), "text", "label",
                F.lit("dictionary").alias("source"), "concept_id", F.lit(0).alias("priority"))
    )


def longest_non_overlapping(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Greedy choice by (priority, longest, leftmost) among overlapping spans.

    Spans that touch no other span need no decision. The others fall into clusters of transitively
    overlapping spans; the greedy fold runs inside a cluster, so its cost does not grow with the
    length of the document.
    """
    s = spans if "priority" in spans.columns else spans.withColumn("priority", F.lit(0))
    by_start = W.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    clustered = s.withColumn("_new", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0)).withColumn(
        "_c", F.sum("_new").over(by_start.rowsBetween(W.unboundedPreceding, 0))
    )
    cols = [c for c in spans.columns if c not in (key, "start", "end")]
    item = F.struct(
        F.col("priority").alias("_p"), (F.col("start") - F.col("end")).alias("_neg"), "start", "end", *[F.col(c).alias(f"v_{c}") for c in cols]
    )
    groups = clustered.groupBy(key, "_c").agg(F.sort_array(F.collect_list(item)).alias("_s"))
    clash = lambda a, x: F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    fold = F.aggregate(
        F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", 1, 1),
        lambda a, x: F.when(clash(a, x), a).otherwise(F.concat(a, F.array(x))),
    )
    return groups.select(key, F.explode(fold).alias("x")).select(
        key, "x.start", "x.end", *[F.col(f"x.v_{c}").alias(c) for c in cols]
    )


# ----------------------------------------------------------------------------- interval joins
def _binned(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(end) - 1) / BIN))
    return spans.select(*keys, start, end, F.explode(bins).alias("_bin"))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, start, end, b_start, b_end) of overlapping spans.

    Equi-join on (keys, position bin), so a very long document is spread over its bins.
    """
    left = _binned(a.select(*keys, "start", "end").distinct(), keys, "start", "end")
    right = _binned(
        b.select(*keys, F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct(), keys, "b_start", "b_end"
    )
    hit = left.join(right, [*keys, "_bin"]).where("start < b_end AND b_start < end")
    # a pair that shares several bins is reported by the first of them only
    once = F.col("_bin") == F.floor(F.greatest("start", "b_start") / BIN)
    return hit.where(once).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` that overlap some span of ``b``."""
    return a.join(overlap_pairs(a, b, keys).select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_semi")


def suppress_overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` that overlap no span of ``b``."""
    return a.join(overlap_pairs(a, b, keys).select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


# ------------------------------------------------------------------------------------ merging
def dedupe_spans(spans: DataFrame, key: str = "doc_id", priority: str = "priority") -> DataFrame:
    """First span per boundary by priority (then label, source for a fixed result)."""
    cols = [c for c in spans.columns if c not in (key, "start", "end", priority)]
    m = F.min_by(F.struct(*cols), F.struct(priority, "label", "source"))
    return spans.groupBy(key, "start", "end").agg(m.alias("m")).select(key, "start", "end", "m.*")


def union_spans(members: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Merge extractors; for equal boundaries the earlier member wins."""
    if not members:
        raise ValueError("nothing to merge: give one span table or more")
    out = None
    for i, m in enumerate(members):
        d = m.withColumn("priority", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return dedupe_spans(out, key)


def filter_spans(spans: DataFrame, labels=None, sources=None) -> DataFrame:
    if labels:
        spans = spans.where(F.col("label").isin(list(labels)))
    if sources:
        spans = spans.where(F.col("source").isin(list(sources)))
    return spans


def entity_key(text: Column, fold: str = "casefold") -> Column:
    if fold not in ("exact", "casefold"):
        raise ValueError(f"texts are compared 'exact' or 'casefold', not {fold!r}")
    return F.lower(F.trim(text)) if fold == "casefold" else F.trim(text)


def distinct_entities(spans: DataFrame, key: str = "doc_id", fold: str = "casefold") -> DataFrame:
    """Distinct entity strings per document with the first surface form and its place."""
    first = F.min(F.struct("start", "end", "label", F.trim("text").alias("entity")))
    return (
        spans.where(F.length(F.trim("text")) > 0)
        .groupBy(key, entity_key(F.col("text"), fold).alias("ent_key"))
        .agg(first.alias("m"))
        .select(key, "ent_key", F.col("m.entity").alias("entity"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    )


def first_mention_per_concept(spans: DataFrame, key: str = "doc_id", concept: str = "concept_id") -> DataFrame:
    return spans.where(F.col(concept).isNotNull()).groupBy(key, concept).agg(F.min_by("text", F.struct("start", "end")).alias("text"))


def found_by(spans: DataFrame, key: str = "doc_id", fold: str = "casefold", source: str = "source") -> DataFrame:
    """Sorted set of sources that found each entity."""
    return spans.groupBy(key, entity_key(F.col("text"), fold).alias("ent_key")).agg(
        F.array_join(F.sort_array(F.collect_set(source)), ",").alias("found_by")
    )


def extraction_summary(spans: DataFrame, docs: DataFrame, key: str = "doc_id", extractor: str = "extractor") -> DataFrame:
    """Per extractor, label and source: spans, documents hit, and share of documents without any span."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    hit = spans.groupBy(extractor).agg(F.count_distinct(key).alias("_hit"))
    return (
        spans.groupBy(extractor, "label", "source").agg(F.count(F.lit(1)).alias("n_spans"))
        .join(hit, extractor)
        .withColumn("empty_share", F.lit(1.0) - F.col("_hit") / n_docs.scalar())
        .drop("_hit")
    )


# ----------------------------------------------------------------------------------- BIO tags
def bio_to_spans(df: DataFrame, tags: str = "tags", key: str = "doc_id") -> DataFrame:
    """BIO tag arrays -> spans. An I without an open span starts one; typed tags lose their type."""
    bare = df.select(key, F.transform(tags, lambda t: F.substring_index(t, "-", 1)).alias("_b"))
    bare = bare.where(
        F.when(F.forall("_b", lambda t: t.isin("B", "I", "O")), F.lit(True)).otherwise(F.raise_error(F.lit("unexpected BIO tag")).cast("boolean"))
    )
    at = lambda i: F.coalesce(F.get("_b", i), F.lit("O"))
    idx = F.when(F.size("_b") > 0, F.sequence(F.lit(0), F.size("_b") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(idx, lambda i: (at(i) == "B") | ((at(i) == "I") & (at(i - 1) == "O")))
    ends = F.transform(F.filter(idx, lambda i: (at(i) != "O") & (at(i + 1) != "I")), lambda i: i + 1)
    return bare.select(key, F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("s")).select(
        key, F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end")
    )


def spans_to_bio(lengths: DataFrame, spans: DataFrame, key: str = "doc_id", n: str = "n_tokens") -> DataFrame:
    """Non-overlapping spans -> one tag array per document, linear in its length."""
    per_doc = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    d = lengths.select(key, n).join(per_doc, key, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    rep = lambda v, k: F.array_repeat(F.lit(v), k.cast("int"))
    body = F.flatten(F.transform("_s", lambda s, i: F.concat(
        rep("O", s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("_s", i - 1)["end"])), F.array(F.lit("B")), rep("I", s["end"] - s["start"] - 1))))
    last = F.coalesce(F.get("_s", F.size("_s") - 1)["end"], F.lit(0))
    return d.select(key, F.concat(body, rep("O", F.col(n) - last)).alias("tags"))


# -------------------------------------------------------------------------------- incremental
def incremental_extract(
    texts: DataFrame, store: DataFrame | None, fingerprint: str, extract: Callable[[DataFrame], DataFrame], text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(all results by text hash, results to append) for one configuration fingerprint.

    Only distinct texts without a stored result are extracted. ``extract`` maps
    (text_hash, text) to rows that carry ``text_hash``. A text without any span is stored as a
    marker row with NULL values, so it is not retried.
    """
    distinct = texts.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text")).dropDuplicates(["text_hash"])
    todo = distinct
    if store is not None:
        known = store.where(F.col("fingerprint") == fingerprint)
        todo = distinct.join(known.select("text_hash").distinct(), "text_hash", "left_anti")
    fresh = todo.select("text_hash").join(extract(todo), "text_hash", "left").withColumn("fingerprint", F.lit(fingerprint))
    if store is None:
        return fresh, fresh
    return known.unionByName(fresh).join(distinct.select("text_hash"), "text_hash", "left_semi"), fresh
