"""Consensus of scorers: pools are ranked where they lie, large ones through the tie table, with the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenmatch.operators import annotation as A


def test_pools_are_shuffled_once(spark, monkeypatch):
    d = spark.range(240).selectExpr("element_at(array('a', 'b'), cast(id % 2 + 1 AS int)) AS scorer", "if(id < 200, 1, 2) AS jd_id", "id div 2 AS bio_id", "cast(pmod(xxhash64(id), 7) AS double) AS score")
    d = d.unionByName(d.where("bio_id = 3"))  # an item may come twice
    c = A.consensus_scores(d, ["a", "b"])
    assert c._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    small = {(r.jd_id, r.bio_id): r.consensus for r in c.collect()}
    monkeypatch.setattr(A, "POOL_ROWS", 100)  # the first pool is larger
    both = {(r.jd_id, r.bio_id): r.consensus for r in A.consensus_scores(d, ["a", "b"]).collect()}
    assert len(small) == 120 and small == both


def test_ranks_by_hand(spark):
    d = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 5.0), ("a", 1, 3, 7.0), ("a", 1, 4, 1.0)], "scorer string, jd_id int, bio_id int, score double")
    got = {r.bio_id: r.consensus for r in A.consensus_scores(d, ["a"]).withColumn("consensus", F.round("consensus", 6)).collect()}
    assert got == {1: 0.625, 2: 0.625, 3: 1.0, 4: 0.25}
