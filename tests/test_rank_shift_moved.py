"""Rank shifts of moved, unmoved and tied scores in pools that are kept together in the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenmatch.operators import fairness as H
from evenmatch.plans.views import Tables


def test_moved_and_unmoved_rows_get_their_ranks(spark):
    rows = [("a", 1, 1, 5.0, 5.0), ("a", 1, 2, 5.0, 1.0), ("a", 1, 3, 3.0, 6.0), ("a", 1, 4, 1.0, 1.0), ("a", 2, 5, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "scorer string, jd_id long, bio_id long, score double, pert_score double")
    both = d.withColumn("condition", F.lit("swap")).unionByName(d.withColumns({"condition": F.lit("noop"), "pert_score": F.col("score")}))
    got = {(r.condition, r.bio_id): (r.rank_orig, r.rank_pert) for r in H.rank_shift(both, ["scorer", "jd_id"], once=("condition", "swap")).collect()}
    before = {1: 1.5, 2: 1.5, 3: 3.0, 4: 4.0, 5: 1.0}
    after = {1: 1.5, 2: 3.5, 3: 1.0, 4: 4.0, 5: 1.0}
    assert got == {("swap", b): (before[b], after[b]) for b in before} | {("noop", b): (before[b], before[b]) for b in before}


def test_scored_pairs_keep_pools_together(spark):
    parts = Tables(spark, "/root/testdata/sf0.001")._scored_pairs().select("jd_id", F.spark_partition_id().alias("p")).distinct()
    n_parts, n_pools, n = parts.select("p").distinct().count(), parts.select("jd_id").distinct().count(), parts.count()
    assert n <= n_pools + n_parts  # a range boundary parts one pool at most
