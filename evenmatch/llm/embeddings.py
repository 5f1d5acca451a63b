"""Near-duplicate embeddings through a pivot-permutation index.

Reference points are a seeded sample of the vectors. Every vector is described by its nearest
reference points in order; inverted lists, one for each pair of reference points, hold the vectors
that have both among their closest (see ``nearest``). So two vectors meet if they share two reference
points at least, and are then verified by their cosine in double precision.

Equal vectors are one node with a weight. Nodes within half the angle of ``COSINE`` of one other
node, the one with the smallest hash in their lists, form a ball: any two of them are linked by the
triangle inequality, without being compared. In a list, whoever is outside its largest ball is
compared with all others, tile by tile inside the tasks. A pair is counted in one list only, that
of the two smallest reference points it shares; counts leave a task, never the pairs of a list.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing. Vectors
of different lengths are compared within their length only, one length after the other. Repeated rows
count as further vectors, and so does every row of an id that has several vectors. Rows with a null id
link like others; their component is the smallest id in it, null where it has none.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import Scratch
from .graph import components

COSINE = 0.9
BALL = math.cos(math.acos(COSINE) / 2) + 1e-6
SHARED = 2
LEAST_POINTS, MOST_POINTS = 64, 4096  # reference points: the square root of the number of nodes within these bounds
TILE = 512


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector can link with any other."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _packed(kind: type):
    def pack(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
            cut = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]).astype(int)
            values = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.binary())], names=["id", "v"])

    return pack


def nearest(points: int) -> int:
    """How many closest reference points describe a vector: more where they lie closer together."""
    return max(6, math.ceil(math.log2(points)) if points > 1 else 1)


def _described(points: np.ndarray, kind: type):
    most = nearest(len(points))

    def describe(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = np.sort(np.argsort(-(_unit(_rows(batch.column("v"), kind)) @ points.T), axis=1, kind="stable")[:, :most], axis=1)
            width = near.shape[1]
            keys = np.stack([near[:, i] * len(points) + near[:, j] for i, j in combinations(range(width), SHARED)], 1)
            as_list = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).astype(t)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "v", "w")], as_list(near, np.int32), as_list(keys, np.int64)], names=["id", "v", "w", "near", "lists"])

    return describe


def _in_ball(kind: type):
    def check(batches):
        for batch in batches:
            if len(batch):
                near = (_unit(_rows(batch.column("v"), kind)) * _unit(_rows(batch.column("lead_v"), kind))).sum(1) >= BALL
                ball = pa.array(np.where(near, batch.column("lead").to_numpy(), batch.column("id").to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), ball], names=["id", "ball"])

    return check


def _compared(kind: type, points: int):
    def links(rows: list) -> list:
        few, many = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not few or not many:
            return []
        x, y = (_unit(np.frombuffer(b"".join(r[5] for r in side), kind).reshape(len(side), -1)) for side in (few, many))
        (ix, bx, wx), (iy, by, wy) = ([np.array([r[k] for r in side]) for k in (1, 2, 3)] for side in (few, many))
        major = np.array([r[6] for r in many])
        i, j = np.nonzero(x @ y.T >= COSINE)
        keep = bx[i] != by[j]
        i, j = i[keep], j[keep]
        nx, ny = np.array([r[4] for r in few]), np.array([r[4] for r in many])
        both = (nx[i][:, :, None] == ny[j][:, None, :]).any(2)
        first = np.argmax(both, 1)
        both[np.arange(len(i)), first] = False
        own = nx[i, first] * points + nx[i, np.argmax(both, 1)] == rows[0][7]
        i, j = i[own], j[own]
        found: dict = {}
        for a, b, w in zip(ix[i].tolist(), by[j].tolist(), wy[j].tolist(), strict=True):
            found[a, b] = found.get((a, b), 0) + w
        back = major[j]
        for a, b, w in zip(iy[j][back].tolist(), bx[i][back].tolist(), wx[i][back].tolist(), strict=True):
            found[a, b] = found.get((a, b), 0) + w
        return [(a, b, n) for (a, b), n in found.items()]

    def compare(batches):
        group, held = None, []
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["id", "ball", "n"])
        for batch in batches:
            table, out = batch.to_pydict(), []
            for key, mb, ab, *row in zip(*(table[c] for c in ("key", "mb", "ab", "role", "id", "ball", "w", "near", "v", "major")), strict=True):
                if (key, mb, ab) != group:
                    out += links(held)
                    group, held = (key, mb, ab), []
                held.append((*row, key))
            yield pack(out)
        yield pack(links(held))

    return compare


def embedding_links(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row."""
    work = Scratch(table.sparkSession, "embeddings")
    kind = np.float32 if table.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = usable(F.col("v")) & (F.size("v") > 0)
    lengths = sorted(r["n"] for r in rows.where(good).select(F.size("v").alias("n")).distinct().collect())
    out = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for n in lengths:  # vectors of one length at a time
        out = out.unionByName(_links(rows.where(good & (F.size("v") == n)), kind, work, f"{n}-"))
    component = F.col("component_id")
    return out.select(F.col("id").alias(id_col), "n_links", component, F.col("id").eqNullSafe(component).alias("kept"))


def _links(rows: DataFrame, kind: type, work: Scratch, tag: str) -> DataFrame:
    """``id, n_links, component_id`` of every row; all vectors can link and have one length.

    A node is a vector with the least id that has it. Where another vector has that id as well, or the
    vector has no id, the node gets a substitute above all ids, and ``true`` keeps the id it stands for.
    """
    packed = work.write(rows.select("id", "v", F.size("v").alias("n")).mapInArrow(_packed(kind), "id long, v binary"), f"{tag}packed")
    equal = work.write(packed.groupBy("v").agg(F.min("id").alias("true"), F.count("*").alias("w")), f"{tag}equal")
    own = equal.where("true is not null").groupBy("true").agg(F.min("v").alias("v")).select("v", F.col("true").alias("id"))
    above = (packed.agg(F.max("id")).first()[0] or 0) + 1
    nodes = equal.join(own, "v", "left").withColumn("id", F.coalesce("id", F.lit(above) + F.monotonically_increasing_id()))
    nodes = work.write(nodes.select("id", "v", "w", "true"), f"{tag}nodes")
    spare, nodes = nodes.where(F.col("id") >= above).select("id", "true"), nodes.drop("true")
    count = nodes.count()
    n = min(MOST_POINTS, max(LEAST_POINTS, math.isqrt(count)))
    sample = nodes.orderBy(F.xxhash64("v", F.lit(7)), "v").select("v").limit(n).collect()  # MOST_POINTS rows at most
    points = _unit(np.frombuffer(b"".join(r["v"] for r in sample), kind).reshape(len(sample), -1)) if sample else np.zeros((1, 1))
    if 0 < len(points) < SHARED:
        points = np.repeat(points, SHARED, 0)
    made = work.write(nodes.mapInArrow(_described(points, kind), "id long, v binary, w long, near array<int>, lists array<long>"), f"{tag}described")

    lists = made.select("id", F.explode("lists").alias("key")).withColumn("h", F.xxhash64("id", F.lit(5)))
    shared = lists.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("low")).where("n > 1")
    members = work.write(lists.join(shared.select("key", "low"), "key"), f"{tag}members")
    heads = members.where("h = low").select(F.col("h").alias("low"), F.col("id").alias("lead")).groupBy("low").agg(F.min("lead").alias("lead"))
    leads = members.groupBy("id").agg(F.min("low").alias("low")).join(heads, "low").select("id", "lead")
    sides = leads.join(made.select("id", "v"), "id").join(made.select(F.col("id").alias("lead"), F.col("v").alias("lead_v")), "lead")
    balls = work.write(sides.select("id", "v", "lead", "lead_v").mapInArrow(_in_ball(kind), "id long, ball long"), f"{tag}balls")

    placed = members.select("key", "id").join(balls, "id")
    sizes = placed.groupBy("key", "ball").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "ball")).alias("m"))
    tiles = lambda c: F.ceil(c / TILE).cast("int")
    split = sizes.where("parts > 1").select("key", F.col("m.ball").alias("large"), tiles(F.col("size")).alias("na"), tiles(F.col("size") - F.col("m.n")).alias("nm"))
    placed = placed.join(split, "key").withColumn("major", F.expr("ball = large"))
    tile = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = placed.where("not major").select("key", tile("nm", 1).alias("mb"), every("na").alias("ab"), F.lit(0).alias("role"), "id", "ball", "major")
    many = placed.select("key", every("nm").alias("mb"), tile("na", 2).alias("ab"), F.lit(1).alias("role"), "id", "ball", "major")
    sides = few.unionByName(many).join(made.drop("lists"), "id").repartition("key", "mb", "ab").sortWithinPartitions("key", "mb", "ab", "role")
    sides = sides.select("key", "mb", "ab", "role", "id", "ball", "w", "near", "v", "major")
    found = work.write(sides.mapInArrow(_compared(kind, len(points)), "id long, ball long, n long"), f"{tag}links")

    weights = balls.join(made.select("id", "w"), "id").groupBy("ball").agg(F.sum("w").alias("ball_w"), F.min("id").alias("least"))
    at = made.select("id", "w").join(balls, "id", "left").withColumn("ball", F.coalesce("ball", "id"))
    more = found.groupBy("id").agg(F.sum("n").alias("more"))
    least = weights.select(F.col("ball").alias("other"), F.col("least").alias("v"))
    pairs = found.join(balls.withColumnRenamed("ball", "own"), "id").join(weights.select(F.col("ball").alias("own"), F.col("least").alias("u")), "own").join(least, found["ball"] == F.col("other"))
    parts = components(pairs.select("u", "v"), work, f"{tag}parts")
    at = at.join(weights, "ball", "left").join(more, "id", "left").withColumn("least", F.coalesce("least", "id"))
    at = at.join(parts.withColumnRenamed("id", "least"), "least", "left")
    done = at.select(
        "id", (F.coalesce("ball_w", "w") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    done = work.write(done, f"{tag}done")
    # of a component with substitutes the smallest id may be one that a substitute stands for
    real = F.when(F.col("component_id") < above, F.col("component_id"))
    mended = done.join(spare, "id").groupBy("component_id").agg(F.min("true").alias("spare"))
    done = done.join(mended, "component_id", "left").select("id", "n_links", F.least(real, F.col("spare")).alias("component_id"))
    return packed.join(nodes.select("id", "v").withColumnRenamed("id", "node").join(done.withColumnRenamed("id", "node"), "node").drop("node"), "v").select("id", "n_links", "component_id")
