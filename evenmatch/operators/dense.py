"""Text vectors and dense pair scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import mix_sql


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda z: z["x"] / z["n"])


def embed_texts(
    texts: DataFrame, text: str = "text", dims: int = 64, encoder: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(text, vec): one unit vector per distinct text.

    The built-in vectors are signed hashed character trigrams. ``encoder`` plugs in a model: it gets
    the distinct texts and returns (text, vec), typically through ``mapInArrow``.
    """
    distinct = texts.select(F.col(text).alias("text")).distinct()
    if encoder is not None:
        return encoder(distinct)
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    code = lambda k: f"cast(ascii(substr(g, {k}, 1)) AS bigint)"
    mixed = mix_sql(f"{code(1)} * 65536 + {code(2)}", code(3))
    grams = (
        distinct.select("text", padded.alias("_p"))
        .select("text", F.explode(F.expr("transform(sequence(1, greatest(length(_p) - 2, 1)), i -> substr(_p, i, 3))")).alias("g"))
        .select("text", F.expr(f"{mixed} AS m"))
        .groupBy("text", F.expr(f"cast(m % {dims} AS int) AS dim"))
        .agg(F.sum(F.expr(f"CASE WHEN (m DIV {dims}) % 2 = 0 THEN 1.0D ELSE -1.0D END")).alias("v"))
    )
    # at most one value per dimension and text; array_repeat gives the zeros between them
    filled = grams.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_l")).select(
        "text",
        F.flatten(F.concat(
            F.transform("_l", lambda z, i: F.concat(
                F.array_repeat(F.lit(0.0), z["dim"] - F.when(i == 0, F.lit(0)).otherwise(F.get("_l", i - 1)["dim"] + 1)), F.array(z["v"]))),
            F.array(F.array_repeat(F.lit(0.0), F.lit(dims - 1) - F.get("_l", F.size("_l") - 1)["dim"])))).alias("_v"),
    )
    return filled.select("text", _unit(F.col("_v")).alias("vec"))


def chunk_mean_embedding(windows: DataFrame, key: str, vec: str = "embedding", pos: str = "pos", method: str = "chunk_mean") -> DataFrame:
    """One unit vector per text from its window vectors: renormalised mean, or the first window."""
    if method == "truncate":
        return windows.groupBy(key).agg(F.min_by(vec, pos).alias("_f")).select(key, F.transform("_f", lambda x: x.cast("double")).alias("vec"))
    if method != "chunk_mean":
        raise ValueError("method must be 'chunk_mean' or 'truncate'")
    lists = windows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, vec))).alias("_l"))
    zero = F.transform(F.get("_l", F.lit(0))[vec], lambda x: F.lit(0.0))
    total = F.aggregate("_l", zero, lambda acc, z: F.zip_with(acc, z[vec], lambda a, b: a + b.cast("double")))
    # the sum and the mean have the same direction, so the sum is normalised directly
    return lists.select(key, total.alias("_t")).select(key, _unit(F.col("_t")).alias("vec"))


def dense_pair_score(pairs: DataFrame, jd_vecs: DataFrame, bio_vecs: DataFrame) -> DataFrame:
    """pairs + dot product of two unit vectors; ``*_vecs`` hold (jd_id | bio_id, vec)."""
    return (
        pairs.join(jd_vecs.select("jd_id", F.col("vec").alias("_a")), "jd_id")
        .join(bio_vecs.select("bio_id", F.col("vec").alias("_b")), "bio_id")
        .select(*pairs.columns, dot(F.col("_a"), F.col("_b")).alias("score"))
    )
