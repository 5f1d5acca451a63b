"""Mixing sources to target weights by capped water-filling.

Every source gets its weighted share of all words, but no source is read more than ``EPOCHS``
times: sources above that are clamped and what they leave over is shared out again by weight until
no source is above. A source is then repeated whole as often as fits, and the rest is a seeded
part of its documents: they are taken in hash order up to the point nearest to the target, so the
words taken miss the target by half a document at most and no document is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.storage import Scratch
from .columns import restored, shielded

EPOCHS = 3
SEED = "mix-1"
NEEDED = ("doc_id", "text", "source")
_BUCKET = 3  # hex digits of the hash by which a source's running sum is split


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Water-filling over ``source, size, weight``: adds ``target``; sums stay on the executors.

    Each round reads one row: the level at which the open sources share what the clamped ones leave.
    The level only rises, so it is found after as many rounds as there are kinds of clamped sources.
    """
    cap = F.lit(EPOCHS) * F.col("size")
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = -1.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, cap)).alias("clamped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        rise = (total - (row["clamped"] or 0)) / row["open"] if row["open"] else level
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, size`` of every source with its 0-based place in code point order, null last.

    Sources are first split by their leading characters, so that no task sorts all of them.
    """
    by = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    parts = sizes.withColumn("lead", by).withColumn("last", F.col("source").isNull())
    before = W.orderBy("last", "lead").rowsBetween(W.unboundedPreceding, -1)
    leads = parts.groupBy("last", "lead").agg(F.count("*").alias("n")).select("last", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = W.partitionBy("last", "lead").orderBy("source")
    return parts.join(leads, ["last", "lead"]).select("source", "size", (F.col("off") + F.row_number().over(inside) - 1).alias("place"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """All rows and columns of ``docs`` plus ``mix_size, mix_source_size, mix_target, mix_repeats, mix_taken``.

    ``docs`` needs doc_id, text and source. Sources in code point order (null last) get the weights
    in turn. Rows of one source with equal id and size are taken together or not at all. A source without words gets the target 0. An empty table stays empty.
    Other columns may have any name; one that is named like a result is replaced by it.
    """
    own = ("mix_size", "mix_source_size", "mix_target", "mix_repeats", "mix_taken")
    return restored(_mixed(shielded(docs, NEEDED), weights, seed), docs, NEEDED, own)


def repeated(docs: DataFrame) -> DataFrame:
    """A row of ``docs`` for each time that the mix reads it, with the repetition's number as ``epoch``."""
    out = _mixed(shielded(docs, NEEDED)).where("mix_repeats > 0")
    return restored(out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int")))), docs, NEEDED, ("epoch",))


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    work = Scratch(docs.sparkSession, "mix")
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256)
    bucket = F.substring(order, 1, _BUCKET).alias("mix_bucket")
    buckets = work.write(docs.groupBy("source", bucket).agg(F.sum(word_count(F.col("text"))).alias("words")), "buckets")
    sources = ranked_sources(buckets.groupBy("source").agg(F.sum("words").alias("size")))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    goals = targets(work.write(sources.select("source", "size", pick.alias("weight")), "sources"))
    share = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    goals = goals.select("source", "size", "target", F.floor(share).alias("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    before = W.partitionBy("source").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("mix_s"), "mix_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"), "words")
    # the bucket in which the rest of a source ends: only there the order of single documents counts
    ending = goals.join(starts, F.expr("source <=> mix_s and start < rest and start + words >= rest"))
    ending = ending.groupBy("source").agg(F.min(F.struct("mix_bucket", "start")).alias("at"))
    goals = goals.withColumnRenamed("source", "mix_s").join(ending, F.expr("mix_s <=> source"), "left").drop("source")
    goals = work.write(goals.select("mix_s", "size", "target", "whole", "rest", F.col("at.mix_bucket").alias("end_bucket"), F.col("at.start").alias("start")), "goals")
    at_end = docs.select("source", "text", order.alias("mix_order")).join(goals, F.expr(f"source <=> mix_s and substring(mix_order, 1, {_BUCKET}) = end_bucket"))
    units = at_end.select("mix_s", "mix_order", "start", "rest", word_count(F.col("text")).alias("mix_size")).groupBy("mix_s", "mix_order", "mix_size", "start", "rest")
    running = W.partitionBy("mix_s").orderBy("mix_order", "mix_size").rowsBetween(W.unboundedPreceding, -1)
    units = units.agg(F.sum("mix_size").alias("words")).withColumn("upto", F.col("start") + F.coalesce(F.sum("words").over(running), F.lit(0)))
    ends = units.where("words > 0 and upto + words / 2 <= rest").groupBy("mix_s").agg(F.max(F.struct("mix_order", "mix_size")).alias("last"))
    goals = goals.join(ends.withColumnRenamed("mix_s", "e_s"), F.expr("mix_s <=> e_s"), "left").drop("e_s", "start")
    goals = work.write(goals, "plan")
    out = docs.select("*", word_count(F.col("text")).alias("mix_size"), order.alias("mix_order")).join(goals, F.expr("source <=> mix_s"))
    more = F.expr(f"substring(mix_order, 1, {_BUCKET}) < end_bucket or (substring(mix_order, 1, {_BUCKET}) = end_bucket and struct(mix_order, mix_size) <= struct(last.mix_order, last.mix_size))")
    repeats = F.col("whole") + F.when(F.coalesce(more, F.lit(False)) & (F.col("mix_size") > 0), 1).otherwise(0)
    return out.select(
        *[F.col(c) for c in docs.columns], "mix_size", F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        repeats.cast("long").alias("mix_repeats"), (repeats * F.col("mix_size")).cast("long").alias("mix_taken"),
    )


def mix_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: what the mix takes of it."""
    return mixed(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


#: The rows of the mixing query in SQL: the level is the largest of the levels that follow from clamping the sources with the smallest caps per weight.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         sha256('{SEED}|' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, (place % 3 + 1)::BIGINT AS weight, {EPOCHS} * source_size AS cap FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER o AS clamped, sum(weight) OVER () - sum(weight) OVER o AS open
  FROM w WINDOW o AS (ORDER BY cap / weight, place)
), lv AS (
  SELECT greatest(max((total - clamped)::DOUBLE / nullif(open, 0)), max(total)::DOUBLE / (SELECT sum(weight) FROM w)) AS level FROM r
), g AS (
  SELECT w.*, least(cap::DOUBLE, level * weight) AS target FROM w, lv
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
), c AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source, d.h, d.size) AS unit,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size RANGE UNBOUNDED PRECEDING) AS cum
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN size > 0 AND cum - unit / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
