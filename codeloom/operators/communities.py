"""Components, communities and measures of them over undirected edges u, v."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.traversal import undirected
from codeloom.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node that can be reached.

    In turns every node joins the least of its neighbourhood to the greater ones, and to the lesser
    ones, until nothing changes; the number of turns grows with the logarithm of a component's width.
    """
    now = written(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low).distinct()
        after = written(small)
        discard(now)
        now = after
        # the turn changed nothing if the edges are the same, which their number and the sum of their hashes tell
        marks = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if marks == before:
            break
        before = marks
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _propagated(both: DataFrame, rounds: int) -> DataFrame:
    """node and community over edges in both directions, in rounds until no label changes."""
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "community").agg(F.count(F.lit(1)).alias("n"))
        after = written(votes.groupBy(F.col("u").alias("node")).agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community")))
        stable = after.join(labels, ["node", "community"], "left_anti").isEmpty()
        labels = after
        if stable:
            break
    return labels


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node and community: each node takes the commonest label around it, the least of equals, all at once, until nothing changes, for so many rounds at most.

    A community of more than 10 nodes and of more than a quarter of all is split by labels that spread
    within it alone, once; nodes without an edge inside it then stand alone. Labels that alternate
    without end are those of the last round.
    """
    both = written(undirected(edges.where("u <> v").select("u", "v")))
    labels = written(_propagated(both, rounds))
    most = max(10, int(labels.count() * 0.25))
    large = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("community")
    inside = written(labels.join(large, "community", "left_semi"))
    if inside.isEmpty():
        return labels
    a, b = inside.select(F.col("node").alias("u"), F.col("community").alias("cu")), inside.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    split = _propagated(written(both.join(a, "u").join(b, "v").where("cu = cv").select("u", "v")), rounds)
    # a part is named by its least node, so that no two of different communities share a name
    parts = inside.join(split.withColumnRenamed("community", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    names = parts.groupBy("community", "part").agg(F.min("node").alias("name"))
    kept = labels.join(large, "community", "left_anti").select("node", "community")
    # the others keep theirs, which may be a node that went into a part, so they are named alike
    kept = kept.join(kept.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", F.col("name").alias("community"))
    return kept.unionByName(parts.join(names, ["community", "part"]).select("node", F.col("name").alias("community")))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, n_nodes, n_edges within and cohesion: their share of all pairs, 1 for a single node."""
    a = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    inner = pairs.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    out = sizes.join(inner, "community", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("cohesion", F.when(F.col("n_nodes") <= 1, 1.0).otherwise(F.round(F.col("n_edges") * 2.0 / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 2)))


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a < b and n_edges, the edges between two communities."""
    x = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    y = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    met = edges.join(x, "u").join(y, "v").where("cu <> cv")
    return met.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"))


def reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, community and reach, the number of other communities among its neighbours."""
    x = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    y = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    met = undirected(edges.select("u", "v")).join(x, "u").join(y, "v").where("cu <> cv").select("u", "cu", "cv").distinct()
    return met.groupBy(F.col("u").alias("node"), F.col("cu").alias("community")).agg(F.count(F.lit(1)).alias("reach"))


def surprise(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v and score of edges (u, v, confidence, relation) between files, given node, kind, top_dir, community and source of the nodes.

    The less certain an edge and the further apart its ends, the more: 3, 2 or 1 by confidence, 2 for
    different kinds of file, 2 for different top directories, 1 for different communities; half as
    much again for similarity of meaning; 1 if an end of small degree meets one of large.
    """
    both = edges.select("u", "v").union(edges.select("v", "u"))
    degree = both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    with_degree = nodes.join(degree, "node")
    end = lambda s: with_degree.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "top_dir", "community", "source", "degree")])
    met = edges.where(~F.col("relation").isin("imports", "imports_from", "contains", "method")).join(end("u"), "u").join(end("v"), "v").where("u_source <> v_source")
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    base = base + F.when(F.col("u_kind") != F.col("v_kind"), 2).otherwise(0) + F.when(F.col("u_top_dir") != F.col("v_top_dir"), 2).otherwise(0) + F.when(F.col("u_community") != F.col("v_community"), 1).otherwise(0)
    base = F.when(F.col("relation") == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base)
    edge = F.when((F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5), 1).otherwise(0)
    return met.select("u", "v", (base + edge).cast("int").alias("score"))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node and betweenness over the shortest paths from the nodes of sources, by Brandes' accumulation.

    All sources advance together: one row for each source and node reached, level by level outwards
    with the counts of paths, and back again with the dependencies, each level a join.
    """
    both = written(undirected(edges.select("u", "v")))
    level = written(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "node")
    while True:
        step = both.join(level.withColumnRenamed("node", "u"), "u").groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "node"))
    after = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("share"))
    total = after.select("s", "node", "share")
    for before in reversed(levels[:-1]):
        back = both.join(after.select("s", F.col("node").alias("v"), F.col("paths").alias("pv"), "share"), "v").join(before.select("s", F.col("node").alias("u"), F.col("paths").alias("pu")), ["s", "u"])
        gained = back.groupBy("s", F.col("u").alias("node")).agg(F.sum(F.col("pu") / F.col("pv") * (1 + F.col("share"))).alias("share"))
        after = written(before.join(gained, ["s", "node"], "left").select("s", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share")))
        total = total.union(after.select("s", "node", "share"))
    return total.where("s <> node").groupBy("node").agg(F.sum("share").alias("betweenness"))
