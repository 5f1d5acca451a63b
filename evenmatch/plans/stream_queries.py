"""Streaming jobs as named queries: drained over the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical as L, wording
from ..sources.storage import shared_dir, written
from ..streaming import jobs
from .catalog import query
from .eval_queries import coded_texts
from .score_queries import corpus, r6
from .views import Tables, with_views as V


def source(t: Tables, name: str):
    """One of the given tables as a stream of files; the table is one file or a folder of files."""
    schema = t.spark.read.parquet(f"{t.path}/{name}.parquet").schema
    # a stream takes a plain path for a folder, a pattern for either
    return t.spark.readStream.schema(schema).parquet(f"{t.path}/{name}.parque[t]")


class StreamTables(Tables):
    """The views over streams instead of tables."""

    def read(self, name: str):
        return source(self, name)

    def ratings(self):
        # event time needs a time zone
        return super().ratings().withColumn("ts", F.col("ts").cast("timestamp"))


def drained(t: Tables, start, name: str):
    sink, check = shared_dir(t.spark, name), shared_dir(t.spark, f"{name}-state")
    start(sink, check).awaitTermination()
    return t.spark.read.parquet(sink)


@query("stream_wording", V("wscore", "SELECT bio_id, n_words, m AS masculine_count, f AS feminine_count, score, verdict FROM wscore"))
def _(t):
    texts = coded_texts(StreamTables(t.spark, t.path))
    return drained(t, lambda s, c: jobs.stream_wording(texts, wording.form_table(t.spark), s, c), "wording").drop("batch")


@query("stream_latest_ratings", V("lat", "SELECT * FROM lat"))
def _(t):
    ratings = StreamTables(t.spark, t.path).ratings()
    return jobs.latest_state(drained(t, lambda s, c: jobs.stream_latest_ratings(ratings, s, c), "latest"))


@query("stream_match", V("bm25", "SELECT jd_id, bio_id, round(score, 6) AS score FROM bm25"))
def _(t):
    # fit and pairs are written once; a micro-batch reads no other text
    idf, stats = (written(d, "fit") for d in L.bm25_fit(L.term_vectors(corpus(t), "doc")))
    queries = written(L.term_vectors(t.jds(), "jd_id"), "queries")
    pairs = written(t.pairs().select("jd_id", "bio_id"), "pairs")

    def score(batch):
        return L.bm25_score(pairs.join(batch.select("bio_id"), "bio_id"), queries, L.term_vectors(batch, "bio_id"), idf, stats)

    texts = StreamTables(t.spark, t.path).v1()
    return drained(t, lambda s, c: jobs.stream_match(texts, score, s, c), "match").select("jd_id", "bio_id", r6("score"))


@query("stream_dedup", V("v1", "SELECT sha256(text) AS text_hash, count(*) - count(*) + 1 AS n FROM v1 GROUP BY 1"))
def _(t):
    texts = StreamTables(t.spark, t.path).v1().select("bio_id", "text", F.timestamp_seconds(F.lit(1700000000) + F.col("bio_id")).alias("ts"))
    return drained(t, lambda s, c: jobs.stream_dedup(texts, s, c), "dedup").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))


@query("stream_rating_counts", V("v6", """, h AS (SELECT date_trunc('hour', ts) AS hour, annotator, count(*) AS n_ratings FROM v6 GROUP BY 1, 2)
 SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, annotator, n_ratings FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v6) - INTERVAL 2 HOUR"""))
def _(t):
    ratings = StreamTables(t.spark, t.path).ratings()
    d = drained(t, lambda s, c: jobs.stream_rating_counts(ratings, s, c), "hours")
    return d.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "annotator", "n_ratings")
