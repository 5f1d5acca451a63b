"""Span errors: both sides are shuffled once, and odd spans are counted as joins by boundaries count them."""

from __future__ import annotations

from evenmatch.operators import span_eval as K

SCHEMA = "doc_id int, start long, end long, text string"
PRED = [(1, 0, 2, "Ab c"), (1, 5, 9, "De f"), (1, 60, 140, "Long Run"), (1, 200, 201, "Lone"), (1, 200, 201, "Lone"), (2, 0, 1, "Far"), (None, 0, 1, "Nobody"), (3, 1, None, "Endless"), (4, 1, 3, "Twice"), (4, 1, 3, "Twice")]
GOLD = [(1, 0, 2, "Ab c"), (1, 6, 7, "E"), (1, 8, 9, "F"), (1, 62, 150, "Long Way"), (1, 138, 139, "Inner"), (1, 300, 301, "Gone"), (1, 300, 301, "Gone"), (2, 1, 2, "Near"), (None, 0, 1, "Nobody"),
        (3, 1, None, "Endless"), (4, 0, 2, "Over"), (4, 0, 2, "Over"), (4, 2, 130, "Wide"), (4, 1, 3, "Twice")]
EXPECTED = {
    ("false_positive", "lone", 2), ("false_positive", "far", 1), ("false_positive", "nobody", 1), ("false_positive", "endless", 1),
    ("boundary", "E  ->  De f", 1), ("boundary", "F  ->  De f", 1), ("boundary", "Long Way  ->  Long Run", 1), ("boundary", "Inner  ->  Long Run", 1),
    ("boundary", "Over  ->  Twice", 2), ("boundary", "Wide  ->  Twice", 1),
    ("missed", "gone", 2), ("missed", "near", 1), ("missed", "nobody", 1), ("missed", "endless", 1)}


def test_texts_are_shuffled_once(spark):
    pred, gold = spark.createDataFrame(PRED, SCHEMA), spark.createDataFrame(GOLD, SCHEMA)
    d = K.span_errors(pred, gold)
    assert {tuple(r) for r in d.collect()} == EXPECTED
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # spans met by nine joins, each of which shuffled them
    assert {tuple(r) for r in K.span_errors(pred, gold, 2000).collect()} == EXPECTED


def test_only_the_most_frequent_are_listed(spark):
    pred = spark.createDataFrame([(i, 0, 1, f"w{i % 5 % 4}") for i in range(10)], SCHEMA)
    assert [tuple(r) for r in K.span_errors(pred, pred.where("false"), 1).collect()] == [("false_positive", "w0", 4)]
