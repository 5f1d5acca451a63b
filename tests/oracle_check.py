"""Compare named queries with their SQL on one folder of tables.

    python tests/oracle_check.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def make_spark(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("evenmatch")
        .config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(df, sql: str, con):
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    t0 = time.time()
    rel = con.execute(sql)
    want_cols, want = canon([d[0] for d in rel.description], rel.fetchall())
    if time.time() - t0 > 5:
        print(f"     (the SQL took {time.time() - t0:.1f}s)", flush=True)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)}; extra {extra}; lacking {lacking}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:3]}"
    types = {c: type(v).__name__ for r in got[:50] for c, v in zip(got_cols, r) if v is not None}
    types2 = {c: type(v).__name__ for r in want[:50] for c, v in zip(want_cols, r) if v is not None}
    if types != types2:
        return f"types differ: {[(c, types.get(c), types2.get(c)) for c in set(types) | set(types2) if types.get(c) != types2.get(c)]}"
    return "ok" if got else "ok (no rows)"


def main(argv):
    from evenmatch.plans import load_catalog
    from evenmatch.plans.views import Tables

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    catalog = load_catalog()
    keys = [k for k in catalog if not argv or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    path = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), connect(path)
    failed = 0
    for k in keys:
        fn, sql = catalog[k]
        t0 = time.time()
        try:
            df = fn(Tables(spark, path))
            res = compare(df, sql, con) if sql else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad = not res.startswith(("ok", "rows"))
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {k:32s} {time.time() - t0:6.1f}s {res}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
