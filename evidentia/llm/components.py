"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace

MAX_ROUNDS = 60  # a chain of n nodes needs about log2(n)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. edges: (u, v), u > v. Each node hands its least neighbour to its larger, or to all smaller, neighbours."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("n", "x")
        least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
        out = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = down.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(a, b) edges to (id, root): every node with the least node it reaches; nodes without edges have no row.

    Hot nodes: the least neighbour is found by a partial aggregation, and the
    join back is split by adaptive execution. Each round is written out.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.filter("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = space.save(edges, f"{name}-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    if not seen[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    for i in range(1, MAX_ROUNDS):
        edges = space.save(_stars(_stars(edges, True), False), f"{name}-{i}")
        now = mark(edges)
        space.drop(f"{name}-{i - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
