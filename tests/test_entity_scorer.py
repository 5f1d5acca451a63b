"""The entity scorer from text: stores that only grow by what is new, encoders, filters, and a store join without shuffling it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evenmatch.operators.dense import embed_texts
from evenmatch.operators.entity_scorer import EntityScorer
from evenmatch.operators.stores import ResultStore

WORDS = ["welding", "carving", "glazing", "weaving"]


def extract(d):
    """Every known word is a skill; ``Lead`` is a role that the scorer does not keep."""
    toks = d.select("text_hash", F.posexplode(F.split("text", " ")).alias("start", "text"))
    label = F.when(F.lower("text").isin(WORDS), "skill").when(F.col("text") == "Lead", "role")
    return toks.withColumn("label", label).where("label IS NOT NULL").withColumns({"end": F.col("start") + 1, "source": F.lit("words")})


def letters(d):
    """An encoder: one vector per string, made of its letters."""
    return embed_texts(d.select(F.reverse("text").alias("r")), "r").select(F.reverse("text").alias("text"), "vec")


@pytest.fixture
def jds(spark):
    return spark.createDataFrame([(1, "Welding and carving"), (2, "glazing"), (3, "nothing"), (4, "Welding and carving")], "jd_id long, text string")


def rows(spark, *texts):
    return spark.createDataFrame([(j, i, t) for j in (1, 2, 3) for i, t in enumerate(texts)], "jd_id long, text_id long, resume_text string")


def test_scores_and_empty_sides(spark, jds):
    scorer = EntityScorer(spark, extract).fit(jds)
    got = {(r.jd_id, r.text_id): (round(r.score, 6), r.nonempty) for r in scorer.score(rows(spark, "WELDING carving Welding", "Lead", "glazing")).collect()}
    assert got[1, 0] == (1.0, True) and got[2, 2] == (1.0, True) and got[1, 1] == (0.0, False) and got[3, 0] == (0.0, False)
    assert got[1, 2][1] and 0 <= got[1, 2][0] < 1


def test_a_batch_only_learns_what_is_new(spark, jds):
    seen, strings = [], []

    def watched(d):
        seen.append(sorted(r.text for r in d.select("text").collect()))
        return extract(d)

    def encoder(d):
        strings.append(sorted(r.text for r in d.collect()))
        return letters(d)

    scorer = EntityScorer(spark, watched, encoder=encoder).fit(jds)
    scorer.score(rows(spark, "welding", "weaving x")).count()
    scorer.score(rows(spark, "welding", "weaving y")).count()
    assert seen == [["Welding and carving", "glazing", "nothing"], ["weaving x", "welding"], ["weaving y"]]
    assert strings == [["Welding", "carving", "glazing"], ["weaving", "welding"], []]


def test_aggregations_and_report(spark, jds):
    r = rows(spark, "welding glazing")
    for name, limit in (("maxsim_mean", None), ("idf_weighted", None), ("one_to_one", None), ("threshold_fraction", 0.9)):
        got = {x.jd_id: x.score for x in EntityScorer(spark, extract, name, limit, encoder=letters).fit(jds).score(r).collect()}
        assert abs(got[2] - 1) < 1e-9 and got[1] < 1
    scorer = EntityScorer(spark, extract).fit(jds)
    by = {order: [x.jd_ent for x in scorer.report(r, order=order).where("jd_id = 1").orderBy("rank").collect()] for order in ("lost", "weight", "sim")}
    assert by["lost"] == ["carving", "welding"] == by["sim"] and by["weight"] == ["welding", "carving"]
    with pytest.raises(ValueError, match="threshold"):
        EntityScorer(spark, extract, "threshold_fraction")
    with pytest.raises(ValueError, match="fit"):
        EntityScorer(spark, extract).score(r)


def test_the_store_is_not_shuffled(spark):
    store = ResultStore(spark, "plan_test", "k", 8)
    store.append(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id"))
    store.append(spark.range(5000, 9000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id"))
    batch = spark.range(8990, 9010).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh, known = store.missing(batch), store.attach(batch)
        for d, exchanges in ((fresh, 1), (known, 1)):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == exchanges and "Bucketed: true" in plan, plan
        assert fresh.count() == 10 and known.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
