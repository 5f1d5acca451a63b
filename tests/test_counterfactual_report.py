"""The report of counterfactuals: unchanged rewrites, texts without a gender, scorers without a median."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenmatch.operators import rewrite as G

REASON = "no gendered first name or pronouns found"


def test_report_reuses_originals_and_skips_name_conditions(spark):
    scored = spark.createDataFrame([
        ("a", 1, "name_swap_us", "F", True, 2.0, 3.0), ("a", 2, "name_swap_us", None, False, 2.0, 2.5), ("a", 2, "gender_full", None, True, 2.0, 1.0),
        ("a", 3, "pronoun_swap", None, False, 2.0, None), ("b", 1, "name_swap_us", "F", True, 2.0, 3.0),
    ], "scorer string, bio_id int, condition string, gender string, changed boolean, score double, pert_score double")
    medians = spark.createDataFrame([("a", 0.5)], "scorer string, pool_sd_median double")
    d = G.counterfactual_report(scored, medians, ["scorer", "bio_id", "condition"], "gender")
    assert {tuple(r) for r in d.select("scorer", "bio_id", "condition", "changed", "original", "perturbed", "delta", "delta_norm", "skipped").collect()} == {
        ("a", 1, "name_swap_us", True, 2.0, 3.0, 1.0, 2.0, None), ("a", 2, "name_swap_us", False, None, None, None, None, REASON),
        ("a", 2, "gender_full", True, 2.0, 1.0, -1.0, -2.0, None), ("a", 3, "pronoun_swap", False, 2.0, 2.0, 0.0, 0.0, None), ("b", 1, "name_swap_us", True, 2.0, 3.0, 1.0, None, None)}


def test_check_goes_from_texts_to_the_report(spark):
    bios = spark.createDataFrame([(1, "Anna Moss tuned her harp. She sang."), (2, "A driven cook tuned a harp.")], "bio_id int, text string")
    jds = spark.createDataFrame([(7, "A harp is tuned.")], "jd_id int, text string")
    lexicon = spark.createDataFrame([("anna", "F", 1.0), ("paul", "M", 1.0)], "name string, gender string, share double")
    pools = spark.createDataFrame([(p, g, 0, n, 1) for p, g, n in (("us", "F", "Ruth"), ("us", "M", "Paul"), ("in", "F", "Asha"), ("in", "M", "Ravi"))], "pool string, gender string, idx long, name string, n long")
    she = lambda d: d.select("jd_id", "text_id", F.size(F.regexp_extract_all(F.lower("resume_text"), F.lit(r"\b(she|her)\b"), F.lit(0))).cast("double").alias("score"), F.lit(True).alias("nonempty"))
    medians = spark.createDataFrame([("she", 0.5)], "scorer string, pool_sd_median double")
    d = G.counterfactual_check(bios, jds, bios.select("bio_id", F.lit(7).alias("jd_id")), lexicon, pools, {"she": she}, medians)
    got = {(r.bio_id, r.condition): r for r in d.collect()}
    assert set(got) == {(b, c) for b in (1, 2) for c in G.CONDITIONS}
    full = got[1, "gender_full"]
    assert (full.gender, full.original, full.perturbed, full.delta_norm) == ("F", 2.0, 0.0, -4.0) and full.perturbed_text.startswith("Paul Moss tuned his harp. He") and len(full.changes) == 3
    assert {c for (b, c), r in got.items() if r.skipped == REASON} == {"name_swap_us", "name_swap_in", "name_in_same_gender"} == {c for (b, c), r in got.items() if b == 2 and r.original is None}
    unchanged = got[2, "gender_full"]
    assert (unchanged.changed, unchanged.original, unchanged.perturbed, unchanged.skipped, unchanged.gender) == (False, 0.0, 0.0, None, None)
