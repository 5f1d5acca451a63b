"""Cells of the metric table at the edge of their third decimal, against the same format in DuckDB."""

from __future__ import annotations

import duckdb

from evenmatch.operators import reports

EDGES = [0.0625, 0.1235, 0.0005, 0.0015, 2.5005, 1234.5675, -0.0625, -0.0004, 0.9995, 12.0, 0.125, 0.375, 3.0e-7, *[round(k / 1000 + 0.0005, 6) for k in range(-1200, 2400)]]


def test_cells_round_like_printf(spark):
    rows = [(f"s{i}", "test", "swap", "m", v, None if i % 3 == 0 else v / 2, v * 2) for i, v in enumerate(EDGES)]
    tidy = spark.createDataFrame(rows, "scorer string, split string, condition string, metric string, value double, ci_low double, ci_high double")
    got = {r.scorer: r.swap for r in reports.metric_pivot(tidy, "m", ["swap"]).collect()}
    con = duckdb.connect()
    for scorer, _, _, _, value, low, high in rows:
        sql, args = ("printf('%.3f', ?)", [value]) if low is None else ("printf('%.3f [%.3f, %.3f]', ?, ?, ?)", [value, low, high])
        assert got[scorer] == con.execute(f"SELECT {sql}", args).fetchone()[0], (value, low, high)
