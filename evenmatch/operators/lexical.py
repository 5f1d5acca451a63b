"""BM25 and TF-IDF pair scores.

A text becomes one row with its distinct terms and their counts (a narrow projection, no shuffle).
Corpus statistics explode the distinct terms and combine map-side. Pairs are scored in place after
two joins by id, so the terms of a pair are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import order_hash, search_tokens
from ..sources.rules import STOP_WORDS


def term_vectors(docs: DataFrame, key: str, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """key, terms (sorted distinct), tfs, dl."""
    toks = docs.select(key, F.sort_array(search_tokens(F.col(text), stop_words)).alias("_s"))
    idx = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    marked = toks.withColumn("_at", F.filter(idx, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))))
    n = F.size("_s")
    return marked.select(
        key,
        F.transform("_at", lambda i: F.get("_s", i)).alias("terms"),
        F.transform("_at", lambda i, k: F.coalesce(F.get("_at", k + 1), n) - i).alias("tfs"),
        n.alias("dl"),
    )


def _tokens(vectors: DataFrame) -> DataFrame:
    """One row per distinct token of each text.

    The outer form: before an inner explode the optimizer would filter on the size of the array, with
    the tokenizing expression copied into the lambdas that build it.
    """
    return vectors.select(F.explode_outer("terms").alias("token")).where("token IS NOT NULL")


def bm25_fit(vectors: DataFrame, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(token, df, idf) and one row (n_docs, avgdl). Negative idf becomes epsilon * mean raw idf."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = _tokens(vectors).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = stats.select("n_docs").scalar()
    raw = df.withColumn("_raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("_raw").alias("m")).scalar()
    return raw.select("token", "df", F.when(F.col("_raw") >= 0, F.col("_raw")).otherwise(mean * epsilon).alias("idf")), stats


def tfidf_fit(vectors: DataFrame, min_df: int = 1) -> DataFrame:
    """(token, df, idf) with the smooth idf ln((1+n)/(1+df)) + 1."""
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = _tokens(vectors).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") >= min_df).select("token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _weighted(vectors: DataFrame, key: str, idf: DataFrame, weight: Column) -> DataFrame:
    """key, terms, ws: the terms of each text that the fitted table knows, with their weights."""
    long = vectors.select(key, F.explode(F.arrays_zip("terms", "tfs")).alias("z")).select(key, F.col("z.terms").alias("token"), F.col("z.tfs").alias("tf"))
    return (
        long.join(idf.select("token", "idf"), "token")
        .groupBy(key).agg(F.collect_list(F.struct(F.col("token").alias("t"), weight.alias("w"))).alias("_l"))
        .select(key, F.col("_l.t").alias("terms"), F.col("_l.w").alias("ws"))
    )


def _at(values: str, terms: str, t: Column) -> Column:
    return F.get(values, F.array_position(terms, t).cast("int") - 1)


def query_terms(queries: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, token, weight): one row per known term of each query, weighted tf x idf."""
    rows = queries.select(key, F.explode_outer(F.arrays_zip("terms", "tfs")).alias("z")).where("z IS NOT NULL")
    return rows.select(key, F.col("z.terms").alias("token"), F.col("z.tfs").alias("tf")).join(idf.select("token", "idf"), "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("weight"))


def bm25_score(
    pairs: DataFrame, queries: DataFrame, docs: DataFrame, idf: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75,
    query_key: str = "jd_id", doc_key: str = "bio_id",
) -> DataFrame:
    """pairs + ``score``. ``queries`` and ``docs`` are term vectors; a pair without shared terms scores 0."""
    q = _weighted(queries, query_key, idf, F.col("tf") * F.col("idf")).withColumnsRenamed({"terms": "_qt", "ws": "_qw"})
    d = docs.withColumn("_norm", F.lit(k1) * (1 - b + b * F.col("dl") / stats.select("avgdl").scalar()))
    d = d.select(doc_key, F.col("terms").alias("_dt"), F.col("tfs").alias("_df"), "_norm")
    j = pairs.join(q, query_key, "left").join(d, doc_key, "left")

    def add(acc, t):
        tf = _at("_df", "_dt", t)
        return acc + _at("_qw", "_qt", t) * tf * (k1 + 1) / (tf + F.col("_norm"))

    score = F.aggregate(F.array_intersect("_qt", "_dt"), F.lit(0.0), add)
    return j.select(*pairs.columns, F.coalesce(score, F.lit(0.0)).alias("score"))


def tfidf_vectors(vectors: DataFrame, key: str, idf: DataFrame, sublinear: bool = True) -> DataFrame:
    """key, terms, ws: L2-normalised TF-IDF rows over the fitted vocabulary."""
    tf = (F.log(F.col("tf")) + 1) if sublinear else F.col("tf").cast("double")
    w = _weighted(vectors, key, idf, tf * F.col("idf"))
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, x: a + x * x))
    # the norm is repeated beside the weights: inside the lambda it would be evaluated per element
    both = F.arrays_zip(F.col("ws").alias("x"), F.array_repeat(norm, F.size("ws")).alias("n"))
    return w.select(key, "terms", F.transform(both, lambda z: z["x"] / z["n"]).alias("ws"))


def tfidf_score(pairs: DataFrame, queries: DataFrame, docs: DataFrame, query_key: str = "jd_id", doc_key: str = "bio_id") -> DataFrame:
    """pairs + cosine ``score`` of TF-IDF rows."""
    q = queries.select(query_key, F.col("terms").alias("_qt"), F.col("ws").alias("_qw"))
    d = docs.select(doc_key, F.col("terms").alias("_dt"), F.col("ws").alias("_dw"))
    j = pairs.join(q, query_key, "left").join(d, doc_key, "left")
    dot = F.aggregate(F.array_intersect("_qt", "_dt"), F.lit(0.0), lambda a, t: a + _at("_qw", "_qt", t) * _at("_dw", "_dt", t))
    return j.select(*pairs.columns, F.coalesce(dot, F.lit(0.0)).alias("score"))


def fit_corpus(
    train: DataFrame, jds: DataFrame, n: int | None = None, seed: int = 0, train_key: str = "bio_id", jd_key: str = "jd_id", text: str = "text"
) -> DataFrame:
    """All training texts, or a seeded sample of ``n``, plus all target texts: (doc, text).

    The sample is drawn on ids, so no text is sorted or sent to one task.
    """
    if n is not None:
        drawn = train.select(train_key).orderBy(order_hash(seed, train_key)).limit(n)
        train = train.join(drawn, train_key, "left_semi")
    return train.select(F.concat(F.lit("t"), F.col(train_key)).alias("doc"), text).unionByName(
        jds.select(F.concat(F.lit("j"), F.col(jd_key)).alias("doc"), text)
    )
