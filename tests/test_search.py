"""Retrieval over the index against scoring every pair, with frequent terms, ties and lists that are too short."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evenmatch.operators import lexical as L, search as S


def texts(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    common, rare = ["alpha", "beta", "gamma"], [f"w{i}" for i in range(60)]
    body = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    docs = [(i, body(rng.randint(1, 40))) for i in range(400)] + [(900 + i, "alpha beta w1 w2") for i in range(30)] + [(990, ""), (991, None)]
    jds = [(i, body(rng.randint(1, 30))) for i in range(25)] + [(50, "alpha"), (51, "unseen words"), (52, ""), (53, "solo"), (54, "w1 w2")]
    return docs + [(995, "solo")], jds


@pytest.mark.parametrize("k,hot", [(1, 20_000), (5, 3), (40, 10)])
def test_search_equals_scoring_every_pair(spark, monkeypatch, k, hot):
    monkeypatch.setattr(S, "HOT", hot)
    docs, jds = texts(k)
    d = L.term_vectors(spark.createDataFrame(docs, "bio_id long, text string"), "bio_id").withColumn("dl", F.coalesce("dl", F.lit(0)))
    q = L.term_vectors(spark.createDataFrame(jds, "jd_id long, text string"), "jd_id")
    idf, stats = L.bm25_fit(d)
    exact = lambda pairs: L.bm25_score(pairs, q, d, idf, stats)
    terms = L.query_terms(q, "jd_id", idf)
    index = S.build_index(S.bm25_postings(d, stats, "bio_id"), 2.5, terms.select("token").distinct())
    got = {(r.jd_id, r["rank"]): (r.bio_id, r.score) for r in S.search(index, terms, q, d, exact, k).collect()}
    every = exact(q.select("jd_id").crossJoin(d.select("bio_id"))).collect()
    want = {}
    for jd in {r.jd_id for r in every}:
        best = sorted(((-round(r.score, 6), r.bio_id) for r in every if r.jd_id == jd))[:k]
        want |= {(jd, i + 1): (b, -s) for i, (s, b) in enumerate(best)}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


def test_frequent_terms_are_not_looked_up(spark):
    """Of a frequent and a rare term, only the rare one's texts become candidates."""
    docs = [(i, "alpha " * (1 + i % 3) + (" solo" * 3 if i < 12 else "")) for i in range(3000)]
    d = L.term_vectors(spark.createDataFrame(docs, "bio_id long, text string"), "bio_id")
    q = L.term_vectors(spark.createDataFrame([(1, "alpha solo")], "jd_id long, text string"), "jd_id")
    idf, stats = L.bm25_fit(d)
    seen = []

    def exact(pairs):
        seen.append(pairs.count())
        return L.bm25_score(pairs, q, d, idf, stats)

    terms = L.query_terms(q, "jd_id", idf)
    out = S.search(S.build_index(S.bm25_postings(d, stats, "bio_id"), 2.5), terms, q, d, exact, 10)
    assert out.count() == 10 and max(seen) <= 12
