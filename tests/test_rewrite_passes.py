"""Rewrites cut each text once per use and carry no pieces out of the row."""

from __future__ import annotations

from evenmatch.operators import rewrite as G

BIOS = [(1, "F", "Anna Moss tuned her harp.  She met  the\tSociety of Women \n Engineers."), (2, "M", "Nothing here needs a change."), (3, "M", "Dr. Paul is here. Paul's pupils admire him.")]


def made(spark):
    bios = spark.createDataFrame(BIOS, "bio_id int, gender string, text string")
    lexicon = spark.createDataFrame([("anna", "F", 1.0), ("paul", "M", 1.0)], "name string, gender string, share double")
    pools = spark.createDataFrame([("us", g, 0, n, 1) for g, n in (("F", "Ruth"), ("M", "Hugh"))] + [("in", g, 0, n, 1) for g, n in (("F", "Asha"), ("M", "Ravi"))],
                                  "pool string, gender string, idx long, name string, n long")
    return bios, lexicon, pools


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_swap_names_cuts_texts_once(spark):
    bios, lexicon, pools = made(spark)
    d = G.swap_names(G.pieces(bios, low=False), lexicon, pools, "us", "opposite")
    assert {r.bio_id: r.names for r in d.collect()} == {1: {"anna": "Hugh"}, 3: {"paul": "Ruth"}}
    assert plan(d).count("regexp_extract_all") == 1


def test_swap_phrases_across_any_white_space(spark):
    bios = made(spark)[0]
    d = G.apply_proposals(G.pieces(bios).withColumn("props", G.swap_phrases()), "props")
    assert {r.bio_id: r.new_text for r in d.collect()} == {
        1: "Anna Moss tuned her harp.  She met  the\tNational Society of Professional Engineers.", 2: BIOS[1][2], 3: BIOS[2][2]}
    assert "regexp_replace" not in plan(d)  # no pattern is run on every piece


def test_samples_rebuild_a_text_once(spark):
    bios, lexicon, pools = made(spark)
    d = G.qa_samples(G.generate_conditions(bios, lexicon, pools), 5, 13)
    assert plan(d).count("regexp_extract_all") == 2  # names, then rewrites
    assert not any("aggregate(" in line for line in plan(d).splitlines() if "Filter" in line)
    marked = {(r.condition, r.bio_id): r.marked for r in d.collect()}
    assert marked[("gender_full", 3)] == "Dr. Paul is here. **Ruth**'s pupils admire **her**."
    assert marked[("name_in_same_gender", 1)].startswith("**Asha** Moss tuned her harp.")
    assert ("pronoun_swap", 2) not in marked


def test_report_keeps_scorers_spread(spark):
    scored = spark.range(400).selectExpr("if(id % 4 = 0, 'a', 'b') AS scorer", "id AS bio_id", "cast(id AS double) AS score", "id + 3.0D AS pert_score")
    medians = spark.range(2).selectExpr("if(id = 0, 'a', 'b') AS scorer", "cast(id * 2 AS double) AS pool_sd_median")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for medians whose size Spark cannot tell
    try:
        d = G.counterfactual_report(scored, medians, ["scorer", "bio_id"])
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
        rows = d.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(rows) == 400 and {(r.scorer, r.delta, r.delta_norm) for r in rows} == {("a", 3.0, None), ("b", 3.0, 1.5)}
