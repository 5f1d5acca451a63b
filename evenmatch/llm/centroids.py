"""Centroid clustering (Lloyd) with zone maps over vectors in the order of a space-filling curve.

The vectors are put into the order of a Hilbert curve and cut into blocks of ``BLOCK`` rows; a block
keeps the least and greatest value of every component (its box). In each round a block first asks
its box: a centroid whose least distance to the box is above another one's greatest is no candidate,
and neither is one that the most promising centroid beats in every point of the box. Only the
remaining candidates are compared with the block's rows, exactly, in integers.

The curve runs over the ``AXES`` leading principal axes of a sample of at most ``SAMPLE`` rows (those
with the smallest hash). The order only decides how tight the boxes are, never the result; equal
vectors are dealt by a hash over several blocks and tasks. A round sends one row per centroid out of
each task; the driver holds the centroids alone.

Components are integers floor(scale * x) (see ``vectors``). Left out: null vectors, vectors with null
or non-finite components or of another length than ``width``. Repeated rows count as often as they
occur. Rows with a null id are assigned like others but start no centroid. With fewer than ``k``
vectors with an id there are fewer centroids; an empty table gives an empty result. Other columns of
the table are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.storage import Scratch
from .vectors import floors, integer_rows, matrix, squared

BLOCK = 512
AXES, BITS = 8, 7
SAMPLE = 4096
LARGEST = (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid cells (rows x axes, each below 2 ** bits)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations, from the coarsest level down
        low = bit - 1
        for i in range(axes):
            flip = (x[:, i] & bit) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[:, -1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


def _curve(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes of the curve, the least value on each, and the width of a cell."""
    centred = (sample - sample.mean(0)).astype(float)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(AXES, sample.shape[1])]
    on = sample @ axes
    low, high = np.quantile(on, 0.005, axis=0), np.quantile(on, 0.995, axis=0)
    return axes, low, np.maximum(high - low, 1e-9) / (1 << BITS)


def _keyed(curve: tuple, width: int):
    axes, low, cell = curve

    def key(batches):
        for batch in batches:
            on = matrix(batch.column("v"), width) @ axes
            cells = np.clip((on - low) // cell, 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("deal"), pa.array(hilbert(cells, BITS))], names=["id", "v", "deal", "place"])

    return key


def _blocks(width: int):
    def pack(ids: pa.Array, rows: list) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), width)
        edges = [pa.array([e.astype(np.int32).tobytes()], pa.binary()) for e in (x.min(0), x.max(0))]
        held = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([held, pa.array([x.tobytes()], pa.binary()), *edges], names=["ids", "x", "low", "high"])

    def cut(batches):
        ids, rows = [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows += batch.column("v").to_pylist()
            while len(rows) >= BLOCK:
                yield pack(pa.array(ids[:BLOCK], pa.int64()), rows[:BLOCK])
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if rows:
            yield pack(pa.array(ids, pa.int64()), rows)

    return cut


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box, ascending; equals stay."""
    near = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    least, most = (near * near).sum(1), (far * far).sum(1)
    best = int(np.argmin(most))
    keep = least <= most[best]
    # greatest value over the box of d(x, best) - d(x, c), which is linear in x: below 0, c never wins
    slope = -2 * (centroids[best] - centroids)
    ahead = (centroids[best] ** 2).sum() - (centroids**2).sum(1) + np.maximum(slope * low, slope * high).sum(1)
    return np.flatnonzero(keep & (ahead >= 0))


def _assign(batch: pa.RecordBatch, centroids: np.ndarray):
    """(ids, matrix, numbers, squared distances) of each block of a batch."""
    width = centroids.shape[1]
    for ids, x, low, high in zip(*(batch.column(c) for c in ("ids", "x", "low", "high")), strict=True):
        rows = matrix([x.as_py()], len(ids.values) * width).reshape(-1, width)
        some = candidates(matrix([low.as_py()], width)[0], matrix([high.as_py()], width)[0], centroids)
        distance = squared(rows, centroids[some])
        at = distance.argmin(1)
        yield ids.values, rows, some[at], distance[np.arange(len(rows)), at]


def _sums(centroids: np.ndarray):
    def add(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, rows, number, _ in _assign(batch, centroids):
                count += np.bincount(number, minlength=len(count))
                for c in np.unique(number):
                    total[c] += rows[number == c].sum(0)
        some = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], names=["cluster", "n", "total"])

    return add


def _assigned(centroids: np.ndarray):
    def name(batches):
        for batch in batches:
            for ids, _, number, distance in _assign(batch, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return name


def hilbert_blocks(vectors: DataFrame, width: int, work: Scratch) -> DataFrame:
    """``ids, x, low, high``: the vectors (``id, v``) in curve order, a row per block of at most ``BLOCK``."""
    sample = vectors.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()
    curve = _curve(matrix([r["v"] for r in sample], width))
    dealt = vectors.select("id", "v", F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    placed = dealt.mapInArrow(_keyed(curve, width), "id long, v binary, deal long, place long")
    placed = placed.repartitionByRange("place", "deal").sortWithinPartitions("place", "deal")
    return work.write(placed.select("id", "v").mapInArrow(_blocks(width), "ids array<long>, x binary, low binary, high binary"), "blocks")


def clusters(
    table: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(``id, cluster, distance`` of every vector kept, the final centroids)."""
    spark, work = table.sparkSession, Scratch(table.sparkSession, "centroids")
    vectors = work.write(integer_rows(table, id_col, vector_col, scale).where(F.col("n") == width).select("id", "v"), "vectors")
    first = vectors.where("id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = matrix([r["v"] for r in first], width)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    blocks = hilbert_blocks(vectors, width, work)
    work.drop("vectors")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>").groupBy("cluster")
        sums = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        centroids = centroids.copy()
        for row in sums.collect():  # a row per centroid
            centroids[row["cluster"]] = [floors(t, row["n"]) for t in row["total"]]
    return work.write(blocks.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "assigned"), centroids


def cluster_report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector kept.

    Sums above the largest long are given as the largest long.
    """
    found, centroids = clusters(table, id_col=id_col, vector_col=vector_col, **options)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    whole = min(sum(sums.values()), LARGEST)
    facts = [(c, min(s, LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(facts), "cluster")  # a row per centroid
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, scale: int = 256, width: int = 64) -> str:
    """The rows of ``cluster_report`` over the embeddings, every vector compared with every centroid."""
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, sha256('2:' || vec_id::varchar) AS h, list_transform(embedding, lambda x: floor({scale} * x::double)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT k.vec_id, k.h, min(struct_pack(d := list_inner_product(k.v, k.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(k.v, c.v), c := c.c)) AS m,
  any_value(k.v) AS v FROM k, c{r} c GROUP BY ALL)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM (
  SELECT m.c AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{r}, range(1, {width + 1}) t(i) GROUP BY 1, 2) GROUP BY 1) u USING (c))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.m.c::int AS cluster, a.m.d::bigint AS distance, sum(a.m.d) OVER (PARTITION BY a.m.c)::bigint AS cluster_inertia, sum(a.m.d) OVER ()::bigint AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::bigint::varchar), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""
    )
