"""Scored pairs turn only their own texts into vectors."""

from __future__ import annotations

from evenmatch.plans import load_catalog
from evenmatch.plans.views import Tables

load_catalog()
from evenmatch.plans.score_queries import tfidf  # noqa: E402


def test_vectors_are_made_for_pairs_only(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = tfidf(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
