"""Small allocations are cut before the shuffle; the sample is the same as by positions in the whole stratum."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenmatch.operators import annotation as A


def test_both_paths_draw_the_same(spark, monkeypatch):
    d = spark.range(500).select((F.col("id") % 3).alias("s"), F.col("id").alias("k"))
    alloc = spark.createDataFrame([(0, 5), (1, 0), (2, 40)], "s long, alloc long")
    draw = lambda: A.stratified_sample(d, ["s"], alloc, 3, ["k"])
    short = draw()
    assert "WindowGroupLimit" in short._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, short.collect()))
    monkeypatch.setattr(A, "GROUP_LIMIT", 0)
    assert len(got) == 45 and got == sorted(map(tuple, draw().collect()))
