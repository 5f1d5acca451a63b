"""The audit from texts to metrics: a scorer that ignores the text shows no gap, one that reads pronouns does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenmatch.operators import rewrite as G
from evenmatch.plans import text_audit_queries as Q
from evenmatch.plans.views import N_CANDIDATES, Tables

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    blind = lambda d: d.select("jd_id", "text_id", (F.col("jd_id") % 7).cast("double").alias("score"), F.lit(True).alias("nonempty"))
    reads = lambda d: d.select("jd_id", "text_id", F.size(F.regexp_extract_all(F.lower("resume_text"), F.lit(r"\b(she|hers?)\b"), F.lit(0))).cast("double").alias("score"), F.lit(True).alias("nonempty"))
    return Q.audited(Tables(spark, PATH), {"blind": blind, "reads": reads}).cache()


def test_every_pair_has_every_condition_once(rows):
    n = rows.select("jd_id", "bio_id").distinct().count()
    assert rows.count() == n * 2 * len(G.CONDITIONS) == rows.select("scorer", "jd_id", "bio_id", "condition").distinct().count()
    assert n == rows.select("jd_id").distinct().count() * N_CANDIDATES


def test_unchanged_rewrites_keep_their_score(rows):
    assert rows.where("not changed and score <> pert_score").count() == 0
    assert rows.where("changed and scorer = 'reads' and condition = 'pronoun_swap' and score <> pert_score").count() > 0


def test_only_the_reading_scorer_has_gaps(rows):
    got = {r.scorer: r.gap for r in Q.metrics(rows).where("condition = 'pronoun_swap'").groupBy("scorer").agg(F.max("abs_gap").alias("gap")).collect()}
    assert got["blind"] == 0 and got["reads"] > 0
