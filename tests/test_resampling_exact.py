"""The exact bootstrap draws the same units whether a series fits a block or not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenmatch.operators import resampling as J
from evenmatch.sources.storage import written


def test_long_series_draw_as_short_ones(spark, monkeypatch):
    d = spark.range(900).select((F.col("id") % 3 == 0).alias("s"), F.col("id").alias("u"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    whole = {r.s: r for r in J.bootstrap_mean_ci(d, ["s"], "u", "v", 100, seed=2).collect()}
    monkeypatch.setattr(J, "BLOCK", 400)  # one series is longer, one is not
    split = {r.s: r for r in J.bootstrap_mean_ci(d, ["s"], "u", "v", 100, seed=2).collect()}
    assert {s: r.n_units for s, r in split.items()} == {True: 300, False: 600}
    for s, r in whole.items():
        assert (split[s].ci_low, split[s].ci_high) == pytest.approx((r.ci_low, r.ci_high), rel=1e-12)


def merged(d):
    """No broadcast in the plan, neither before the run nor after it; small files may hold any number of rows."""
    plan = lambda: d._jdf.queryExecution().executedPlan().toString()
    first = plan()
    rows = d.groupBy("s", "b").count().collect()
    return rows, "Broadcast" not in first and "Broadcast" not in plan()


@pytest.fixture
def units(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield written(spark.range(900).selectExpr("id % 3 = 0 AS s", "id AS u", "cast(id AS double) AS v"), "units")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_draws_are_never_broadcast(units):
    rows, spread = merged(J._drawn(written(J._numbered(units, ["s"], "u", 2), "numbered"), 20, 2))
    assert spread and {(r.s, r.b): r["count"] for r in rows} == {(s, b): 300 if s else 600 for s in (True, False) for b in range(1, 21)}


def test_units_are_never_broadcast(units):
    rows, spread = merged(J.resample(units, ["s"], "u", 20, 2))
    assert spread and {(r.s, r.b): r["count"] for r in rows} == {(s, b): 300 if s else 600 for s in (True, False) for b in range(1, 21)}
