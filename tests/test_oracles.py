"""Named queries against their SQL at the smallest scale. EVENMATCH_ALL=1 runs every query."""

from __future__ import annotations

import os

import pytest

from evenmatch.plans import load_catalog
from evenmatch.plans.views import Tables
from oracle_check import compare, connect

PATH = "/root/testdata/sf0.001"
CATALOG = load_catalog()
QUICK = (
    "cleaning_audit", "stratified_split", "title_status", "build_pools", "token_windows", "dictionary_spans", "longest_non_overlapping", "bm25_score",
    "tfidf_score", "one_to_one_match", "ranking_metrics", "rank_shift", "best_f1_threshold", "bootstrap_mean_ci", "span_prf", "band_grid",
    "stratified_sample", "krippendorff_ordinal", "wording_score", "swap_pronouns", "merge_and_apply", "stream_rating_counts",
    "topk_candidates", "generate_conditions", "entity_scorer", "read_taxonomy", "scorer_validity",
)
KEYS = [k for k, (_, sql) in CATALOG.items() if sql] if os.environ.get("EVENMATCH_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    fn, sql = CATALOG[key]
    assert compare(fn(Tables(spark, PATH)), sql, con).startswith("ok")
