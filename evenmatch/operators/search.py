"""Exact top-k retrieval of texts for queries over an inverted index with score bounds.

A score is a sum over shared terms of (weight of the term in the query) x (its impact in the text),
neither negative. The index holds a row per term and text with the impact, in ``LEVELS`` levels of
impact; for each term and level it knows the number of texts and the greatest impact.

A search needs two looks at the index. The first takes the rarest terms of a query, highest levels
first, until they promise enough texts, and scores the best of those exactly: the k-th of them is a
score that every result must reach. Then the terms are ordered by the most they can contribute. A
text whose strongest term is t scores at most weight(t) x impact + everything the weaker terms can
contribute; only texts that can reach the k-th score this way are candidates, so frequent terms with
little weight are not looked up at all but only finish the scores of texts that others found, and of
the rest only the levels high enough. Candidates are scored exactly and ranked.

A frequent (term, level) is dealt over ``SALTS`` keys, so no term is the work of one task. The index
can be restricted to a vocabulary before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.storage import written
from .pairwise import topk_candidates

LEVELS = 16
HOT = 20_000  # texts of a (term, level) above which it is dealt over SALTS keys
SALTS = 64
PROBE = 8  # the first look goes on until it was promised PROBE * k texts


@dataclass(frozen=True)
class TermIndex:
    """``postings``: token, level, salt, doc, impact; ``units``: token, level, n, top, hot."""

    postings: DataFrame
    units: DataFrame


def bm25_postings(docs: DataFrame, stats: DataFrame, key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(token, doc, impact) of term vectors; a text's BM25 score is the sum of tf x idf x impact over a query's terms."""
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / stats.select("avgdl").scalar())
    rows = docs.select(F.col(key).alias("doc"), norm.alias("_norm"), F.explode_outer(F.arrays_zip("terms", "tfs")).alias("z")).where("z IS NOT NULL")
    tf = F.col("z.tfs")
    return rows.select(F.col("z.terms").alias("token"), "doc", (tf * (k1 + 1) / (tf + F.col("_norm"))).alias("impact"))


def build_index(postings: DataFrame, most: float, vocabulary: DataFrame | None = None) -> TermIndex:
    """Index of (token, doc, impact) rows with impacts up to ``most``, written once; ``vocabulary`` (token) keeps only its terms."""
    if vocabulary is not None:
        postings = postings.join(vocabulary.select("token"), "token", "left_semi")
    level = F.least(F.floor(F.col("impact") * LEVELS / F.lit(float(most))), F.lit(LEVELS - 1)).cast("int")
    rows = written(postings.select("token", level.alias("level"), "doc", "impact"), "postings")
    units = rows.groupBy("token", "level").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"))
    units = written(units.withColumn("hot", F.col("n") > HOT), "units")
    # at most one hot unit in HOT postings; a written table's size is known, so Spark broadcasts it while it is small
    hot = written(units.where("hot").select("token", "level", "hot"), "hot-units")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return TermIndex(rows.join(hot, ["token", "level"], "left").select("token", "level", salt.alias("salt"), "doc", "impact"), units)


def _looked_up(index: TermIndex, wanted: DataFrame) -> DataFrame:
    """The postings of the wanted (token, level, hot) rows."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return wanted.withColumn("salt", F.explode(salts)).join(index.postings, ["token", "level", "salt"])


def search(
    index: TermIndex, queries: DataFrame, query_ids: DataFrame, doc_ids: DataFrame, exact: Callable[[DataFrame], DataFrame], k: int,
    query_key: str = "jd_id", doc_key: str = "bio_id", digits: int = 6,
) -> DataFrame:
    """``query_key, doc_key, score, rank``: the k best texts of every query, ties by the smaller id.

    ``queries`` (query_key, token, weight >= 0) are the terms of the queries in ``query_ids``, ``doc_ids``
    all texts. ``exact`` adds ``score`` to (query_key, doc_key) pairs. Scores are rounded to ``digits``
    before they are ranked. Texts without a shared term score 0 and fill lists that are too short.
    """
    slack = 10.0**-digits
    known = queries.join(index.units.groupBy("token").agg(F.sum("n").alias("df"), F.max("top").alias("top")), "token").where("weight > 0")
    weaker = W.partitionBy(query_key).orderBy("bound", "token").rowsBetween(W.unboundedPreceding, -1)
    known = known.withColumn("bound", F.col("weight") * F.col("top")).withColumn("below", F.coalesce(F.sum("bound").over(weaker), F.lit(0.0)))
    units = known.drop("top", "bound").join(index.units, "token")
    rarest = W.partitionBy(query_key).orderBy("df", "token", F.desc("level")).rowsBetween(W.unboundedPreceding, -1)
    units = written(units.withColumn("promised", F.coalesce(F.sum("n").over(rarest), F.lit(0))), "query-units")

    first = _looked_up(index, units.where(F.col("promised") < PROBE * k)).groupBy(query_key, F.col("doc").alias(doc_key))
    first = topk_candidates(first.agg(F.sum(F.col("weight") * F.col("impact")).alias("score")), k, [query_key], doc_key)
    first = exact(written(first.select(query_key, doc_key), "first-look"))
    reach = first.groupBy(query_key).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") == k)
    reach = written(reach.select(query_key, (F.col("least") - slack).alias("reach")), "reach")

    limit = F.coalesce(F.col("reach"), F.lit(0.0))
    able = units.join(reach, query_key, "left").where(F.col("weight") * F.col("top") + F.col("below") >= limit)
    found = _looked_up(index, able).where(F.col("weight") * F.col("impact") + F.col("below") >= limit).select(query_key, F.col("doc").alias(doc_key))
    # a list that is short of k has fewer than k texts with a score, so 2k ids hold enough without one
    spare = doc_ids.select(doc_key).orderBy(doc_key).limit(2 * k).agg(F.collect_list(doc_key).alias("ids"))
    short = query_ids.select(query_key).join(reach, query_key, "left_anti").withColumn(doc_key, F.explode(spare.scalar()))
    pairs = written(found.unionByName(short.select(query_key, doc_key)).distinct(), "candidates")
    scored = exact(pairs).withColumn("score", F.round("score", digits))
    return topk_candidates(scored.select(query_key, doc_key, "score"), k, [query_key], doc_key)
