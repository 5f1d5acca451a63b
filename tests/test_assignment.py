"""The optimal assignment against exhaustive search on matrices up to 7 x 7, with ties and negative values, and its bounds on larger ones."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from evenmatch.operators.entities import assignment_sum


def best(rows: list[list[float]]) -> float:
    if len(rows) > len(rows[0]):
        rows = [list(c) for c in zip(*rows)]
    return max(sum(row[j] for row, j in zip(rows, p)) for p in itertools.permutations(range(len(rows[0])), len(rows)))


def test_equals_exhaustive_search(spark):
    rng = random.Random(7)
    cases = []
    for n in range(1, 8):
        for m in range(1, 8):
            for kind in range(2):
                value = (lambda: rng.choice([-1.0, 0.0, 0.5, 0.5, 1.0])) if kind else (lambda: rng.uniform(-1, 1))
                cases.append([[value() for _ in range(m)] for _ in range(n)])
    d = spark.createDataFrame(list(enumerate(cases)), "i int, sims array<array<double>>")
    got = {r.i: r.s for r in d.select("i", assignment_sum(F.col("sims")).alias("s")).collect()}
    assert all(abs(got[i] - best(c)) < 1e-9 for i, c in enumerate(cases))


def test_empty_sides_and_a_planted_optimum(spark):
    rng = random.Random(1)
    n = 30
    order = list(range(n))
    rng.shuffle(order)
    planted = [[1.0 if order[i] == j else rng.uniform(0, 0.9) for j in range(n)] for i in range(n)]
    rows = [(0, []), (1, [[]]), (2, planted)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, sims array<array<double>>").select("i", assignment_sum(F.col("sims")).alias("s")).collect()}
    assert got[0] is None and got[1] is None and abs(got[2] - n) < 1e-9
