"""Connected components of a link table, with joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, component_id`` (smallest reachable id) of every node of ``links`` (columns ``u, v``).

    Alternating stars: each round hangs the larger neighbours of a node below its smallest one
    (large star), then the smaller neighbours of a node below the smallest of them (small star),
    until all trees are stars. A node with very many neighbours is only ever a grouping key with a
    map-side minimum and the key of a skewed join. Every round is a written table.
    """
    edges = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("m")).where("x > m").distinct()
    step = 0
    edges = scratch.write(edges, f"{name}-{step}")
    while not _stars(edges):
        both = edges.select("x", F.col("m").alias("y")).unionByName(edges.select(F.col("m").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # a row for each edge at most; those that are equal meet in the distinct below
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), "m")
        large = scratch.write(large, f"{name}-{step}-large")
        down = large.join(large.groupBy("x").agg(F.min("m").alias("low")), "x")
        small = down.select("x", F.col("low").alias("m")).unionByName(down.select(F.col("m").alias("x"), F.col("low").alias("m"))).where("x > m").distinct()
        step += 1
        edges = scratch.write(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
    children = edges.select(F.col("x").alias("id"), F.col("m").alias("component_id"))
    return children.unionByName(children.select(F.col("component_id").alias("id"), "component_id").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = edges.select("x", F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("m").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("x").agg(F.sum("child").alias("n"), F.max("parent").alias("parent")).where("n > 1 or n = 1 and parent = 1").isEmpty()


def roots(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``components`` of a forest: ``links`` has one ``v < u`` for each ``u``, in one row or several equal ones.

    Each round hangs every node below the parent of its parent, so a tree of depth d takes about log2(d) rounds.
    """
    step = 0
    edges = scratch.write(links.select(F.col("u").alias("x"), F.col("v").alias("m")).distinct().withColumn("moved", F.lit(True)), f"{name}-0")
    while not edges.where("moved").isEmpty():
        above = edges.select(F.col("x").alias("m"), F.col("m").alias("up"))
        step += 1
        moved = edges.select("x", "m").join(above, "m", "left").select("x", F.coalesce("up", "m").alias("m"), F.expr("up is not null").alias("moved"))
        edges = scratch.write(moved, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    children = edges.select(F.col("x").alias("id"), F.col("m").alias("component_id"))
    return children.unionByName(children.select(F.col("component_id").alias("id"), "component_id").distinct())
