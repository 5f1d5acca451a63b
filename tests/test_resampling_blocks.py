"""Bootstrap over blocks: the same draws as before in one block, and a proper n-of-n resample over many."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evenmatch.functions.draws import P
from evenmatch.operators import resampling as J


def mix(a: int, b: int, seed: int) -> int:
    x1 = (a * 1000003 + b * 7919 + seed * 31 + 1) % P
    x2 = (x1 * 48271 + 11) % P
    x3 = (x2 * x2 + 12345) % P
    x4 = (x3 * 69621 + x1) % P
    return (x4 * x4 + 54321) % P


def units(spark, n: int):
    return spark.range(n).select((F.col("id") % 2).alias("s"), F.col("id").alias("u"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))


def test_many_blocks_resample_n_of_n(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    d = units(spark, 700).select("s", F.col("u").alias("_u"), F.col("v").alias("_v"))
    blocks = J._blocks(d, ["s"], 5)
    rows = {s: {r["_c"]: r["_a"] for r in blocks.where(F.col("s") == s).collect()} for s in (0, 1)}
    got = {(r.s, r.b): r["_r"] for r in J._replicates(blocks, ["s"], 40, 5).collect()}
    for s, arrays in rows.items():
        n = sum(map(len, arrays.values()))
        assert n == 350 and max(map(len, arrays.values())) == 16
        for b in range(1, 41):
            counts: dict[int, int] = {}
            for i in range(n):
                c = (mix(b, i, 5) % n) // 16
                counts[c] = counts.get(c, 0) + 1
            drawn = [arrays[c][mix(b, c * 16 + j, 5) % len(arrays[c])] for c, m in counts.items() for j in range(m)]
            assert len(drawn) == n and math.isclose(got[s, b], sum(drawn) / n, rel_tol=1e-12)


def test_interval_has_the_width_of_the_normal_one(spark, monkeypatch):
    d = units(spark, 4000)
    whole = {r.s: r for r in J.bootstrap_mean_ci(d, ["s"], "u", "v", 400, seed=2).collect()}
    monkeypatch.setattr(J, "BLOCK", 64)
    split = {r.s: r for r in J.bootstrap_mean_ci(d, ["s"], "u", "v", 400, seed=2).collect()}
    sd = d.groupBy("s").agg(F.stddev("v").alias("sd")).collect()
    for r in sd:
        want = 2 * 1.96 * r.sd / math.sqrt(2000)
        for got in (whole[r.s], split[r.s]):
            assert got.n_units == 2000 and abs(got.ci_high - got.ci_low - want) < 0.15 * want and got.ci_low < got.value < got.ci_high
