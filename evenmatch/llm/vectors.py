"""Vectors as rows of integers: preparation and exact distances, with numpy inside the tasks.

A component x becomes floor(scale * x), x taken as a double. Integers saturate at ``LIMIT`` in
either direction, so that no squared distance of up to 1,024 components leaves 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 1 << 25
_EXACT = 1 << 52  # sums of products below this are exact in doubles


def _integers(scale: int):
    def convert(batches):
        for batch in batches:
            vectors = batch.column("v")
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(length)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = np.flatnonzero((bad[at[1:]] == bad[at[:-1]]) & pc.is_valid(vectors).to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(scale * flat)), -LIMIT, LIMIT).astype(np.int32)
            rows = pa.array([whole[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())
            take = pa.array(keep)
            size = pa.array(length[keep].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tag").take(take), size, rows], names=["id", "tag", "n", "v"])

    return convert


def integer_rows(table: DataFrame, id_col: str, vector_col: str, scale: int, tag: Column | None = None) -> DataFrame:
    """``id, tag, n, v``: the rows whose vector is neither null nor holds null or non-finite components.

    ``n`` is the number of components and ``v`` holds them as 32-bit integers, one after another.
    """
    tag = F.lit(None).cast("int") if tag is None else tag
    rows = table.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(_integers(scale), f"id long, tag {rows.schema['tag'].dataType.simpleString()}, n int, v binary")


def matrix(column, width: int) -> np.ndarray:
    """The packed vectors of an Arrow column (or list) as a matrix of 64-bit integers."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(values), np.int32).reshape(len(values), width).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``y``, as 64-bit integers."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(y).max()))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(y)), np.int64)
    for j, row in enumerate(y):
        out[:, j] = ((x - row) ** 2).sum(1)
    return out


def floors(total: int, count: int) -> int:
    """floor(total / count) in whole numbers."""
    return int(total) // int(count)
