"""Streams over several micro-batches: bounded state, late rows, copies in a later batch, texts that arrive after the fit."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evenmatch.streaming import jobs

DAY = dt.datetime(2024, 1, 1, 12)


def at(day: float) -> dt.datetime:
    return DAY + dt.timedelta(days=day)


@pytest.fixture
def batches(spark, tmp_path):
    """Writes one file per batch and reads them as a stream of one file a trigger."""

    def make(schema: str, *parts):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        return spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")

    return make


def test_latest_ratings_keep_little_state(spark, tmp_path, batches):
    schema = "annotator string, pair_id long, rating int, ts timestamp, event_id long"
    first = [("a", p, 0, at(0), p) for p in range(50)]
    second = [("a", 1, 2, at(60), 100), ("a", 2, 3, at(60.1), 101), ("a", 2, 1, at(60.05), 102)]
    third = [("a", 3, 1, at(59), 103)]
    fourth = [("a", 3, 2, at(58), 105), ("b", 4, 2, at(5), 104)]  # the last one lies behind the watermark by then
    query = jobs.stream_latest_ratings(batches(schema, first, second, third, fourth), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(totals) >= 50 and totals[-1] <= 5, totals
    log = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.annotator, r.pair_id): r.rating for r in jobs.latest_state(log).collect()}
    assert got == {("a", p): 0 for p in range(50)} | {("a", 1): 2, ("a", 2): 3, ("a", 3): 1}
    small = jobs.compacted(log, str(tmp_path / "compact"))
    assert small.count() == 50 and {(r.annotator, r.pair_id): r.rating for r in jobs.latest_state(small).collect()} == got


def test_copies_in_later_batches_are_dropped(spark, tmp_path, batches):
    parts = [
        [(1, "one", at(0)), (2, "two", at(0))], [(3, "one", at(1)), (4, "three", at(1))], [(5, "two", at(0.5)), (6, "two", at(2))],
        [(8, "x", at(90))], [(10, "y", at(91))], [(7, "one", at(92))],
    ]
    stream = batches("bio_id long, text string, ts timestamp", *parts)
    jobs.stream_dedup(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["one", "one", "three", "two", "x", "y"]  # a copy that comes after the state has gone counts as new


def test_texts_are_scored_as_they_arrive(spark, tmp_path, batches):
    seen = []

    def score(batch):
        seen.append(sorted(r.bio_id for r in batch.collect()))
        return batch.select("bio_id", F.length("text").cast("double").alias("score"))

    stream = batches("bio_id long, text string", [(1, "a")], [(2, "bb"), (3, "ccc")])
    jobs.stream_match(stream, score, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert seen == [[1], [2, 3]]
    assert sorted((r.bio_id, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
