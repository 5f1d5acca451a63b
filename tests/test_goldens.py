"""Hand-computed results on small inline tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evenmatch.functions.text import layout_to_sentences, match_case, normalize_title, parse_fit_score, search_tokens
from evenmatch.operators import annotation as A, entities as E, fairness as H, nearmiss as N, pools as P, ranking as R, resampling as J, rewrite as G, span_eval as K, spans as S, titles as T, wording
from evenmatch.sources import rules


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


# ---------------------------------------------------------------------------------------- text
def test_text_expressions(spark):
    assert one(spark, "\tLead   Baker | Pastry (Night)\t", normalize_title) == "lead baker pastry night"
    toks = one(spark, "They ported F# and C++ to Rust; we use C#.", lambda c: search_tokens(c, ["they", "and", "to", "we"]))
    assert toks == ["ported", "f#", "c++", "rust", "use", "c#"]
    out = one(spark, "Ada Quill\nBridge Keeper\n\n• Oiled every hinge\n- Ropes, Bells.", layout_to_sentences)
    assert out == "Ada Quill.\nBridge Keeper.\nOiled every hinge.\nRopes, Bells."
    assert one(spark, "THEIRS", lambda c: match_case(c, F.lit("mine"))) == "MINE"


@pytest.mark.parametrize("text, want", [("My score = 61", 61.0), ("roughly 33 / 100 overall", 33.0), ("it ends in 58.", None), ("so 58 it is", 58.0), ("cannot tell", None), ("score: 250, rather 12", 12.0)])
def test_parse_fit_score(spark, text, want):
    assert one(spark, text, parse_fit_score) == want


# --------------------------------------------------------------------------------------- titles
TITLES = [
    ("charge nurse, night shift", ["nurse"], []), ("physician associate", [], []), ("cloud architect", [], []), ("architectural designer", [], ["architect"]),
    ("tax accountant", ["accountant"], []), ("accountant assistant", [], []), ("accounting specialist", [], ["accountant"]), ("deputy counsel", ["attorney"], []),
    ("stand-up comic", ["comedian"], []), ("comedy writer", [], ["comedian"]), ("ballet composer", ["composer"], []), ("music director", [], ["composer"]),
    ("speaker and poet", [], []), ("village poet", ["poet"], []), ("creative writer", [], ["poet"]), ("statistical model", [], []), ("hand model", ["model"], []),
    ("court reporter", [], []), ("war correspondent", ["journalist"], []), ("news editor", [], ["journalist"]), ("spray painter", [], []), ("muralist", ["painter"], []),
    ("parish priest", ["pastor"], []), ("hospital chaplain", [], ["pastor"]), ("strength coach", [], ["personal_trainer"]), ("dietitian aide", [], []),
]


def test_match_titles(spark):
    d = spark.createDataFrame([(t,) for t, _, _ in TITLES], "title_norm string")
    got = {r.title_norm: (r.strong, r.weak) for r in T.match_titles(d, rules.OCCUPATIONS).collect()}
    for title, strong, weak in TITLES:
        assert got[title] == (strong, weak), title


# ------------------------------------------------------------------------------------- ranking
def pool(spark, rows, cols):
    return spark.createDataFrame([("p", *r) for r in rows], "pool string, " + cols)


def test_expected_ranks(spark):
    d = pool(spark, [(0, 7.0), (1, 2.0), (2, 7.0), (3, 7.0), (4, 9.0)], "i int, score double")
    assert [r.expected_rank for r in R.expected_ranks(d, ["pool"]).orderBy("i").collect()] == [3.0, 5.0, 3.0, 3.0, 1.0]


def metrics(spark, scores, rel, graded=None):
    rows = list(zip(scores, rel, graded or rel))
    return R.pool_metrics(pool(spark, rows, "score double, rel_binary int, rel_graded int"), ["pool"], ks=(2, 3)).first().asDict()


def test_ranking_metrics(spark):
    tied = (1 + 1 / math.log2(3) + 1 / math.log2(4)) / 3  # one relevant item among three tied ones
    assert metrics(spark, [5.0, 5.0, 5.0], [0, 1, 0])["ndcg@10"] == pytest.approx(tied)
    assert metrics(spark, [4.0, 3.0, 2.0], [0, 0, 1])["ndcg@10"] == pytest.approx(1 / math.log2(4))
    assert metrics(spark, [3.0, 1.0, 2.0], [0, 0, 0])["ndcg@10"] is None
    m = metrics(spark, [8.0, 8.0, 6.0, 6.0, 6.0], [1, 0, 1, 0, 1])  # after two places one hit, of the third place 2/3
    assert m["p@2"] == pytest.approx(1 / 2) and m["p@3"] == pytest.approx((1 + 2 / 3) / 3)
    assert metrics(spark, [5.0, 5.0, 5.0], [0, 1, 0])["mrr"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    assert metrics(spark, [9.0, 4.0, 4.0], [0, 1, 0])["mrr"] == pytest.approx((1 / 2 + 1 / 3) / 2)
    assert metrics(spark, [3.0, 1.0, 2.0], [0, 0, 0])["mrr"] == 0


def test_null_score_fails(spark):
    with pytest.raises(Exception, match="NULL or NaN"):
        R.tie_groups(pool(spark, [(None,), (1.0,)], "score double"), ["pool"]).collect()


def test_pool_gaps(spark):
    # the last item falls from 6 to 1: 5 points against its sign and from rank 1 to 3; of three items a third each
    rows = [(2.0, 2.0, 1, 0), (5.0, 5.0, -1, 0), (6.0, 1.0, -1, 1)]
    d = pool(spark, rows, "score double, pert_score double, sign int, changed int").withColumns({"nonempty": F.lit(True), "pert_nonempty": F.lit(True)})
    g = H.pool_gaps(H.rank_shift(d, ["pool"]), ["pool"]).first()
    assert g.abs_gap == pytest.approx(5 / 3) and g.abs_gap_changed == pytest.approx(5.0)
    assert g.signed_gap_changed == pytest.approx(5.0) and g.abs_rank_shift_changed == pytest.approx(2.0)


def test_unchanged_rewrites_have_no_gap(spark):
    rows = [(1.0, 1.0, 1, 0), (2.0, 2.0, -1, 0)]
    d = pool(spark, rows, "score double, pert_score double, sign int, changed int").withColumns({"nonempty": F.lit(True), "pert_nonempty": F.lit(True)})
    g = H.pool_gaps(H.rank_shift(d, ["pool"]), ["pool"]).first()
    assert g.abs_gap == 0 and g.abs_rank_shift == 0 and g.abs_gap_changed is None


def test_holm_and_percentile(spark):
    d = spark.createDataFrame([("f", 0.2), ("f", 0.012), ("f", 0.02), ("f", None)], "fam string, p_value double")
    got = {r.p_value: r.p_holm for r in J.holm_adjust(d, ["fam"]).collect()}
    assert got[0.012] == pytest.approx(0.036) and got[0.02] == pytest.approx(0.04) and got[0.2] == pytest.approx(0.2) and got[None] is None
    q = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.5, 1.0)])
    for v, want in ((-1.0, 0.0), (0.0, 0.0), (0.25, 62.5), (0.75, 87.5), (2.0, 100.0)):
        assert one(spark, v, lambda c: J.percentile_of(c, q), "double") == pytest.approx(want)


def test_bootstrap_holds_the_mean(spark):
    d = spark.createDataFrame([("s", i, float(i % 7)) for i in range(60)], "s string, u int, v double")
    row = J.bootstrap_mean_ci(d, ["s"], "u", "v", 50).first()
    assert row.ci_low <= row.value <= row.ci_high and row.n_units == 60


def test_pools_need_enough_bios(spark):
    bios = spark.createDataFrame([(i, i % 4, "FM"[i // 4 % 2]) for i in range(48)], "bio_id int, bio_occ int, bio_gender string")
    jds = spark.createDataFrame([(0, 0), (1, 3)], "jd_id int, jd_occ int")
    codes = spark.createDataFrame([(0, "11-1"), (1, "11-2"), (2, "12-1"), (3, "12-2")], "class int, code string")
    full = P.build_pools(bios, jds, 16, 4, 1, codes=codes).collect()
    assert len(full) == 32 and {r.rel_graded for r in full if r.rel_binary} == {2} and {r.rel_graded for r in full} == {0, 1, 2}
    none = P.build_pools(bios, jds, 6, 0, 1).collect()
    assert len(none) == 12 and not any(r.rel_binary for r in none)
    assert len(P.build_pools(bios, jds, 4, 4, 1).collect()) == 8
    with pytest.raises(ValueError, match="too few bios"):
        P.build_pools(bios, jds, 20, 14, 1)
    assert len(P.build_pools(bios, jds, 20, 14, 1, allow_short=True).collect()) < 40


# ------------------------------------------------------------------------------------ entities
def test_aggregations(spark):
    bio = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    jd = [0.2, 0.6, 0.4], [0.1, 0.7, 0.5]  # similarities are the coordinates themselves
    b = spark.createDataFrame([(2, k, f"r{k}", v) for k, v in enumerate(bio)], "bio_id int, pos int, ent_key string, embedding array<double>")
    j = spark.createDataFrame([(1, k, f"j{k}", v, w) for k, (v, w) in enumerate(zip(jd, (3.0, 1.0)))], "jd_id int, pos int, ent_key string, embedding array<double>, weight double")
    pairs = spark.createDataFrame([(1, 2)], "jd_id int, bio_id int")
    joined = E.joined_bags(pairs, E.entity_bags(j, "jd_id", ("weight",)), E.entity_bags(b, "bio_id"))
    r = E.best_matches(joined, ("weight",)).select(
        E.maxsim_mean().alias("m"), E.idf_weighted_maxsim().alias("w"), E.threshold_fraction(0.65).alias("t"), E.one_to_one_match().alias("o")).first()
    assert (r.m, r.w, r.t, r.o) == pytest.approx((0.65, 0.625, 0.5, 0.55))  # greedy: 0.7, then 0.4


# --------------------------------------------------------------------------------------- spans
def test_bio_tags(spark):
    cases = {"OBII": [(1, 4)], "BIBO": [(0, 2), (2, 3)], "OIOI": [(1, 2), (3, 4)], "OO": []}
    d = spark.createDataFrame([(k, list(k)) for k in cases], "doc_id string, tags array<string>")
    got = {}
    for r in S.bio_to_spans(d).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in cases.items() if v}
    with pytest.raises(Exception, match="unexpected BIO tag"):
        S.bio_to_spans(spark.createDataFrame([("x", ["X"])], "doc_id string, tags array<string>")).collect()


def test_greedy_spans(spark):
    rows = [(5, 9), (8, 11), (2, 6), (11, 12), (0, 2), (20, 21)]
    d = spark.createDataFrame([("d", a, b) for a, b in rows], "doc_id string, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in S.longest_non_overlapping(d).collect()) == [(0, 2), (2, 6), (8, 11), (11, 12), (20, 21)]


def test_span_prf_of_nothing_is_zero(spark):
    schema = "doc_id int, source string, start bigint, end bigint, label string, text string"
    gold = spark.createDataFrame([(1, "s", 0, 2, "skill", "a b")], schema)
    r = K.span_prf(gold.where("false"), gold).where("group = 'all' AND view = 'all' AND mode = 'exact'").first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0)


# ----------------------------------------------------------------------------------- rewriting
def rewritten(spark, sentences, part):
    d = spark.createDataFrame(list(enumerate(sentences)), "bio_id int, text string")
    return [r.new_text for r in G.apply_proposals(G.pieces(d).withColumn("props", part), "props").orderBy("bio_id").collect()]


def check(spark, cases, part):
    assert rewritten(spark, [a for a, _ in cases], part) == [b for _, b in cases]


def test_pronouns(spark):
    check(spark, [
        ("She rows at dawn. Her oars are hers.", "He rows at dawn. His oars are his."), ("He paints his fence.", "She paints her fence."),
        ("The choir asked him to stay.", "The choir asked her to stay."), ("The choir asked her to stay.", "The choir asked him to stay."),
        ("A cellist taught herself Welsh.", "A cellist taught himself Welsh."), ("The last word was hers.", "The last word was his."),
        ("Mr. Vane mends clocks.", "Ms. Vane mends clocks."), ("SHE MENDS CLOCKS.", "HE MENDS CLOCKS."),
        ("He sold her boat to his cousin.", "She sold his boat to her cousin."), ("Both lighthouses are kept by volunteers and their dogs.",) * 2,
    ], G.swap_pronouns())
    check(spark, [("Mr. Vane says he will.", "Mr. Vane says she will.")], G.swap_pronouns(swap_titles=False))


def test_affiliations(spark):
    check(spark, [
        ("The sorority rented a barn.", "The fraternity rented a barn."), ("Two fraternity songs survive.", "Two sorority songs survive."),
        ("They met through the Society of Women Engineers in 1999.", "They met through the National Society of Professional Engineers in 1999."),
        ("A play about women at sea.",) * 2,
    ], G.swap_phrases())


def test_words(spark):
    keep = [
        "The lead sails first.", "The crew was driven by fear.", "A path led to the mill.", "Driving at night tires them.", "They champions-in-waiting trained on.",
        "That habit leads a quiet life.", "The bridge was supported by four piers.", "A wind-driven mill turned.",
    ]
    check(spark, [
        ("Mara led the choir and supports new singers.", "Mara supported the choir and leads new singers."), ("Theirs was a determined effort.", "Theirs was a committed effort."),
        ("They nurtured young oaks.", "They championed young oaks."), ("An ambitious plan won.", "An enthusiastic plan won."),
        ("Mara led crews. To her credit they sang.", "Mara supported crews. To her credit they sang."),  # a sentence end stops the look-ahead
        *[(k, k) for k in keep],
    ], G.rewrite_words())
    with pytest.raises(ValueError):
        G.rewrite_words((("led", "a", "x", "verb", ()), ("Led", "b", "x", "verb", ())))


def test_names_and_conditions(spark):
    lex = spark.createDataFrame([("tilda", "F", 1.0), ("rufus", "M", 0.99), ("robin", "M", 0.6)], "name string, gender string, share double")
    pools = spark.createDataFrame([("us", "F", 0, "Anne", 1), ("us", "M", 0, "Carl", 1), ("in", "F", 0, "Leela", 1), ("in", "M", 0, "Vikram", 1)], "pool string, gender string, idx bigint, name string, n bigint")
    cases = [
        ("Tilda grows quinces. Tilda's jam wins prizes.", "F", "Carl grows quinces. Carl's jam wins prizes."),
        ("Tilda Voss sings with Rufus Voss.", "F", "Carl Voss sings with Rufus Voss."),
        ("Rufus ferments cabbage in Bergen.", "M", "Anne ferments cabbage in Bergen."),
        ("Robin Hale restores organs.", "M", None), ("She repairs kites near the pier.", "F", None),
        ("Tilda Voss keeps her bees. She labels each hive.", "F", "Carl Voss keeps her bees. She labels each hive."),
    ]
    d = spark.createDataFrame([(i, a, g) for i, (a, g, _) in enumerate(cases)], "bio_id int, text string, gender string")
    rows = {(r.bio_id, r.condition): r for r in G.generate_conditions(d, lex, pools).collect()}
    for i, (a, _, want) in enumerate(cases):
        assert rows[(i, "name_swap_us")].text == (want or a)
    full = rows[(5, "gender_full")]
    assert full.text == "Carl Voss keeps his bees. He labels each hive." and {c.kind for c in full.changes} == {"name", "pronoun"}
    for c in full.changes:
        assert full.text[c.start_char:c.end_char] == c.replacement and cases[5][0][c.orig_start:c.orig_end] == c.original
    assert rows[(5, "name_in_same_gender")].text.startswith("Leela")
    with pytest.raises(ValueError):
        G.generate_conditions(d, lex, pools, {"x": ("nope",)})


# ------------------------------------------------------------------- taxonomy, ratings, wording
def test_relations_and_bands(spark):
    edges = spark.createDataFrame([("oak", "tree"), ("elm", "tree"), ("tree", "plant")], "conceptUri string, broaderUri string")
    m = spark.createDataFrame([(1, 1, "oak", "oak", .45), (1, 1, "oak", "elm", .48), (1, 2, "oak", "tree", .70), (1, 2, "oak", "plant", .20)], "jd_id int, bio_id int, jd_concept string, bio_concept string, sim double")
    got = {r.bio_concept: (r.strict, r.lenient) for r in N.concept_related(m, edges).collect()}
    assert got == {"oak": (True, True), "elm": (False, True), "tree": (True, True), "plant": (False, False)}
    r = N.band_grid(N.concept_related(m, edges), [0.35], [0.55]).first()
    assert (r.n, r.strict, r.lenient, r.per_pair) == (2, 0.5, 1.0, 1.0)


def test_agreement(spark):
    a, b = (3, 0, 1, 2, 2, 0), (3, 0, 2, 2, 1, 0)
    d = spark.createDataFrame([(i, n, v) for n, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)], "pair_id int, annotator string, rating int")
    k = A.pairwise_kappa(d).first()
    assert 0 < k.kappa < k.kappa_quadratic < 1 and k.n == 6
    same = d.withColumn("rating", F.col("pair_id") % 4).where("NOT (annotator = 'b' AND pair_id = 5)")
    assert A.krippendorff_ordinal(same).first().alpha == pytest.approx(1.0)


@pytest.mark.parametrize("sizes, n, want", [((100, 10, 1, 0), 20, None), ((5, 4, 3), 2, [1, 1, 0]), ((2, 2), 10, [2, 2])])
def test_allocation(spark, sizes, n, want):
    d = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k int, size bigint")
    got = [r.alloc for r in A.allocate_sample(d, ["k"], n).orderBy("k").collect()]
    if want is None:
        assert sum(got) == n and min(got) >= 1 and got[0] > got[1] > 0
    else:
        assert got == want


def test_wording(spark):
    forms = wording.form_table(spark)
    d = spark.createDataFrame([(1, "kindergarten committee trustee warmup"), (2, "self-reliant leaders collaborating"), (3, "aggressive " + "word " * 99), (4, "kind " + "word " * 99)], "bio_id int, text string")
    flags = {(r.bio_id, r.word): r.matched for r in wording.flag_coded_words(d, forms).collect()}
    assert not any(k[0] == 1 for k in flags)
    assert {w: m for (i, w), m in flags.items() if i == 2} == {"self-reliant": "self-reliant", "leaders": "lead", "collaborating": "collaborate"}
    score = {r.bio_id: r for r in wording.wording_score(d, forms).collect()}
    assert score[3].score == 1.0 and "masculine" in score[3].verdict and score[4].score == -1.0 and "feminine" in score[4].verdict
