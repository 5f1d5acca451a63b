"""Span sweeps stay linear in the length of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenmatch.operators import span_eval as K, spans as S
from evenmatch.plans import load_catalog
from evenmatch.plans.views import Tables

load_catalog()
from evenmatch.plans.text_queries import overlapping_candidates  # noqa: E402


def spans(spark, rows):
    return spark.createDataFrame([(*r, "skill") for r in rows], "doc_id int, start long, end long, label string")


def test_partial_counts_sweep_backwards_for_the_next_start(spark):
    pred = spans(spark, [(1, 0, 2), (1, 5, 9), (1, 9, 10), (1, 20, 30), (2, 0, 1), (3, 4, 6), (3, 4, 8)])
    gold = spans(spark, [(1, 1, 2), (1, 6, 7), (1, 8, 9), (1, 10, 20), (1, 29, 40), (2, 1, 2), (3, 5, 6), (3, 4, 5)])
    d = K.span_partial_counts(pred, gold)
    assert sorted(tuple(r) for r in d.collect()) == [(1, 3, 4), (3, 2, 2)]
    assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_runs_of_flags(spark):
    d = spark.createDataFrame([(1, [True, True, False, None, True]), (2, []), (3, [False]), (4, [True])], "doc_id int, f array<boolean>")
    got = {r.doc_id: [tuple(x) for x in r.s] for r in d.select("doc_id", S.runs(F.col("f")).alias("s")).collect()}
    assert got == {1: [(0, 2), (4, 5)], 2: [], 3: [], 4: [(0, 1)]}


def test_candidates_cut_texts_twice_and_shuffle_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    d = overlapping_candidates(t)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # long words, medium words
    chosen = S.longest_non_overlapping(d)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in chosen.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert all(", start#" not in line for line in exchanges), exchanges
