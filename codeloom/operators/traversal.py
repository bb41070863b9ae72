"""Walks over edges u, v in rounds of joins; each round is written to the shared folder, so that plans stay small and lost executors cost little."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.storage import written


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth and parent of what can be reached from the nodes of start in at most depth steps; the parent is the least one.

    Stops early when nothing new is reached. An empty start gives no rows.
    """
    seen = written(start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(edges.dtypes)["u"]).alias("parent")))
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("u")), "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        frontier = written(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges)).distinct()


def subgraph(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges by which a walk went on: from a node to one of a greater or, in the last step, equal depth."""
    a = reached.select(F.col("node").alias("u"), F.col("depth").alias("du"))
    b = reached.select(F.col("node").alias("v"), F.col("depth").alias("dv"))
    return edges.join(a, "u").join(b, "v").where("dv > du").select("u", "v")


def impact(calls: DataFrame, imports: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """node, depth and relation of what a change at start may touch: callers by steps, and importers that are not among them."""
    back = bfs(reverse(calls), start, depth).where("depth > 0")
    by_call = back.select("node", "depth", F.when(F.col("depth") == 1, "calls").otherwise("transitive_call").alias("relation"))
    by_import = imports.join(start.select(F.col("node").alias("v")).distinct(), "v").select(F.col("u").alias("node")).distinct().join(by_call.select("node"), "node", "left_anti")
    return by_call.unionByName(by_import.select("node", F.lit(1).alias("depth"), F.lit("imports").alias("relation")))


def shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame, most: int = 8) -> DataFrame:
    """hop and node of one shortest path from source to target (one node each), the least parents taken; empty if it has more than most hops."""
    reached = bfs(edges, source, most)
    end = reached.join(target.select("node"), "node")
    path = written(end.select("node", "depth", "parent"))
    out = path
    for _ in range(most):
        path = written(reached.join(path.where("parent is not null").select(F.col("parent").alias("node")), "node").select("node", "depth", "parent"))
        if path.isEmpty():
            break
        out = out.unionByName(path)
    return out.select(F.col("depth").alias("hop"), "node")
