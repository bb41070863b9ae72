"""What reports on a graph and its sources are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.graph import degrees
from codeloom.operators.traversal import undirected


def confidence(edges: DataFrame) -> DataFrame:
    """One row: edges, the percentage of each confidence, and the mean score of inferred ones, 0.5 where none is given."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    share = lambda c: F.round(100 * F.count_if(F.col("confidence") == c) / n, 2).alias(c.lower())
    mean = F.round(F.avg(F.when(F.col("confidence") == "INFERRED", F.coalesce("score", F.lit(0.5)))), 2)
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), share("EXTRACTED"), share("INFERRED"), share("AMBIGUOUS"), mean.alias("mean_inferred"))


def violations(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """problem and id: nodes without id or label or of an unknown kind, ids given twice, and edges that lead nowhere."""
    out = nodes.where("id is null or label is null").select(F.lit("incomplete node").alias("problem"), F.col("id").cast("string").alias("id"))
    out = out.unionByName(nodes.where(~F.col("kind").isin(list(kinds))).select(F.lit("unknown kind").alias("problem"), F.col("id").cast("string").alias("id")))
    out = out.unionByName(nodes.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("problem"), F.col("id").cast("string").alias("id")))
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    return out.unionByName(ends.join(nodes.select("id"), "id", "left_anti").select(F.lit("dangling end").alias("problem"), F.col("id").cast("string").alias("id")))


def representatives(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The surest doubtful edge of each pair of communities: ambiguous before inferred before extracted, then the least ends."""
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).when(F.col("confidence") == "EXTRACTED", 2).otherwise(3)
    x = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    y = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    met = edges.join(x, "u").join(y, "v").where("cu <> cv")
    best = met.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct(rank.alias("rank"), "u", "v", "confidence")).alias("e"))
    return best.select("a", "b", "e.u", "e.v", "e.confidence")


def gaps(edges: DataFrame, labels: DataFrame, thin: int = 3) -> DataFrame:
    """One row: nodes with at most one edge, and communities of fewer than thin nodes."""
    d = degrees(undirected(edges.select("u", "v"))).select("node", "out_degree")
    lone = labels.join(d, "node", "left").agg(F.count_if(F.coalesce("out_degree", F.lit(0)) <= 1).alias("n_isolated"), F.lit(0).alias("n_thin"))
    small = labels.groupBy("community").count().agg(F.lit(0).alias("n_isolated"), F.count_if(F.col("count") < thin).alias("n_thin"))
    return lone.unionByName(small).agg(F.sum("n_isolated").alias("n_isolated"), F.sum("n_thin").alias("n_thin"))


def sources_of(nodes: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """community and files: its first source files by name."""
    each = nodes.select("node", "source").join(labels, "node").select("community", "source").where("source <> ''").distinct()
    nth = each.withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy("source"))).where(F.col("nth") <= most)
    return nth.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "source"))), lambda x: x.source), ",").alias("files"))


def questions(edges: DataFrame, nodes: DataFrame, labels: DataFrame, most: int = 7) -> DataFrame:
    """kind and question, the most pressing first: ambiguous edges, nodes of many inferred edges, isolated nodes, loose communities."""
    from codeloom.operators.communities import cohesion

    name = lambda k: nodes.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    named = edges.join(name("u"), "u").join(name("v"), "v")
    doubtful = named.where("confidence = 'AMBIGUOUS'").select(F.lit(1).alias("n"), F.lit("ambiguous_edge").alias("kind"), F.concat(F.lit("What is the relation of "), "u_label", F.lit(" to "), "v_label", F.lit("?")).alias("question"))
    inferred = named.where("confidence = 'INFERRED'")
    many = inferred.select("u_label").union(inferred.select("v_label")).groupBy("u_label").count().where("count >= 2")
    verify = many.select(F.lit(3).alias("n"), F.lit("verify_inferred").alias("kind"), F.concat(F.lit("Are the "), F.col("count").cast("string"), F.lit(" inferred relations of "), "u_label", F.lit(" right?")).alias("question"))
    lone = nodes.join(undirected(edges.select("u", "v")).select(F.col("u").alias("node")), "node", "left_anti").select(F.lit(4).alias("n"), F.lit("isolated").alias("kind"), F.concat(F.lit("What connects "), "label", F.lit(" to the rest?")).alias("question"))
    loose = cohesion(edges, labels).where("cohesion < 0.15 and n_nodes >= 5").select(F.lit(5).alias("n"), F.lit("low_cohesion").alias("kind"), F.concat(F.lit("Should community "), F.col("community").cast("string"), F.lit(" be split?")).alias("question"))
    return doubtful.unionByName(verify).unionByName(lone).unionByName(loose).orderBy("n", "question").limit(most).select("kind", "question")


def distinct_names(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """df with unique_name: the name, from its second use on with a number behind it."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("nth", n).withColumn("unique_name", F.when(F.col("nth") == 0, F.col(name)).otherwise(F.concat_ws("_", name, F.col("nth").cast("string")))).drop("nth")
