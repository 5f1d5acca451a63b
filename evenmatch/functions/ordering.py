"""Order statistics that survive hot groups.

A plain ``rank() over (partition by group order by value)`` sends a whole group to one task. One
pool may hold a third of all rows, so every rank, quantile and running sum here works in two
levels: rows are first reduced to distinct values (map-side combine), each value falls into a
coarse monotone bucket, bucket totals get a running sum (a few thousand rows per group), and only
the rows of one (group, bucket) are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def sort_bucket(col: Column) -> Column:
    """Monotone coarse bucket of a double, about 0.05 % wide, without a pass over the data."""
    v = col.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * F.lit(1e6)) * F.lit(2048.0)).cast("int")


def tie_table(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with counts of the group and of everything ranked above it.

    Columns: keys, value, ``n``, each sum, then ``above`` (rows with a greater value), ``total``
    (rows of the key), and ``above_<s>`` / ``total_<s>`` for each sum. NULL values are left out.
    """
    sums = dict(sums or {})
    names = ["n", *sums]
    out, keys = list(keys), list(keys)[::-1]  # the last key, mostly a unit's id, tells most rows apart: sorts compare it first
    groups = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(s) for s, c in sums.items()])
        .withColumn("_b", sort_bucket(F.col(value)))
    )
    before = W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = groups.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in names]).select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in names],
        *[F.sum(c).over(whole).alias(f"_tot_{c}") for c in names],
    )
    inside = W.partitionBy(*keys, "_b").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    label = lambda prefix, c: prefix if c == "n" else f"{prefix}_{c}"
    return groups.join(offsets, [*keys, "_b"]).select(
        *out,
        value,
        *names,
        *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(label("above", c)) for c in names],
        *[F.col(f"_tot_{c}").alias(label("total", c)) for c in names],
    )


def average_rank(ascending: bool = True) -> Column:
    """Average rank of a tie group, from ``tie_table`` columns."""
    lower = (F.col("total") - F.col("above") - F.col("n")) if ascending else F.col("above")
    return lower + (F.col("n") + 1) / F.lit(2.0)


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str, ascending: bool = True) -> DataFrame:
    """Add the average rank of ``value`` within ``keys``; NULL values get NULL."""
    ranks = tie_table(df, keys, value).select(*keys, value, average_rank(ascending).alias(out))
    return df.join(ranks, [*keys, value], "left")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles: one row per (keys, p) with ``q``.

    The two order statistics around each position are read off the tie table, so no task ever
    holds all the values of a key.
    """
    ties = tie_table(df, keys, value)
    below = F.col("total") - F.col("above") - F.col("n")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    lo = lambda p: F.floor((F.col("total") - 1) * p)
    hi = lambda p: F.ceil((F.col("total") - 1) * p)
    inside = lambda k: (k >= below) & (k < below + F.col("n"))
    hits = ties.select(
        *keys, value, "total", "n", "above", F.explode(F.filter(ps, lambda p: inside(lo(p)) | inside(hi(p)))).alias("p")
    )
    p = F.col("p")
    ends = hits.groupBy(*keys, "p").agg(
        F.max(F.when(inside(lo(p)), F.col(value))).alias("_lo"),
        F.max(F.when(inside(hi(p)), F.col(value))).alias("_hi"),
        F.max("total").alias("total"),
    )
    frac = (F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)
    return ends.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("q"), "total")


def quantile_row(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """One row with a named quantile of ``value`` per entry."""
    q = quantiles(df, [], value, sorted(set(probs.values())))
    return q.agg(*[F.max(F.when(F.abs(F.col("p") - F.lit(float(p))) < 1e-12, F.col("q"))).alias(n) for n, p in probs.items()])


def hash_position(df: DataFrame, keys: list[str], hash_col: str, out: str, count: str | None = None) -> DataFrame:
    """0-based position in hash order within ``keys``, in two levels on the leading hex digits.

    The offsets are merged in: rows that come from small compressed files would be broadcast to them, hashes
    and all, and the window after the join needs the rows dealt out as the merge does.
    """
    d = df.withColumn("_hb", F.substring(F.col(hash_col), 1, 3))
    before = W.partitionBy(*keys).orderBy("_hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_hb")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            *keys,
            "_hb",
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
            F.sum("_c").over(W.partitionBy(*keys)).alias("_cnt"),
        )
    )
    inside = W.partitionBy(*keys, "_hb").orderBy(hash_col)
    pos = (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint").alias(out)
    extra = [F.col("_cnt").alias(count)] if count else []
    return d.join(offsets.hint("merge"), [*keys, "_hb"]).select(*df.columns, pos, *extra)


def attach_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row table as a struct column through a scalar subquery (no join)."""
    return df.withColumn(name, one_row.select(F.struct("*").alias("s")).scalar())
