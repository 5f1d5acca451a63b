"""Streaming jobs. Each takes a streaming DataFrame and a sink folder and returns the started query.

Sinks are parquet folders written per micro-batch under the batch id, so a batch that is retried
after a failure overwrites its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotation import latest_ratings
from ..operators.wording import wording_score


def _per_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_wording(texts: DataFrame, forms: DataFrame, sink: str, checkpoint: str, key: str = "bio_id") -> StreamingQuery:
    """Wording score of arriving texts; a text is complete in its batch."""
    return _per_batch(texts, lambda b: wording_score(b, forms, key), sink, checkpoint)


def stream_match(texts: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Score arriving texts against a static target set; ``score`` is a batch scorer."""
    return _per_batch(texts, score, sink, checkpoint)


def stream_latest_ratings(ratings: DataFrame, sink: str, checkpoint: str, watermark: str = "30 days", window: str = "1 day") -> StreamingQuery:
    """Latest rating per (annotator, pair) by its own timestamp.

    State holds the latest rating of a key within one window of event time and goes once the watermark
    has passed the window, so it is bounded by the ratings of the watermark's span. A row that is later
    than that is left out. Each batch writes the keys it changed; ``latest_state`` reads the newest row
    per key from all windows, and ``compacted`` keeps only those.
    """
    keys = ["annotator", "pair_id"]
    agg = ratings.withWatermark("ts", watermark).groupBy(F.window("ts", window), *keys).agg(F.max(F.struct("ts", "event_id", "rating")).alias("m"))
    out = agg.select(*keys, "m.ts", "m.event_id", "m.rating")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(log: DataFrame) -> DataFrame:
    return latest_ratings(log, order=("ts", "event_id"))


def compacted(log: DataFrame, path: str) -> DataFrame:
    """The newest row of each key, written to ``path``: what a reader needs of the log up to now."""
    newest = log.groupBy("annotator", "pair_id").agg(F.max(F.struct("ts", "event_id", "rating")).alias("m")).select("annotator", "pair_id", "m.*")
    newest.write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(newest.schema).parquet(path)


def stream_dedup(texts: DataFrame, sink: str, checkpoint: str, text: str = "text", ts: str = "ts", watermark: str = "30 days") -> StreamingQuery:
    """First arrival of each distinct text within the watermark; its hash is kept as state until the watermark has passed it."""
    d = texts.withColumn("text_hash", F.sha2(text, 256)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["text_hash"])
    return d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_rating_counts(ratings: DataFrame, sink: str, checkpoint: str, watermark: str = "2 hours") -> StreamingQuery:
    """Ratings per annotator and tumbling hour; an hour is written once the watermark has passed it."""
    d = ratings.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour"), "annotator").agg(F.count(F.lit(1)).alias("n_ratings"))
    out = d.select(F.col("window.start").alias("hour"), "annotator", "n_ratings")
    return out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
