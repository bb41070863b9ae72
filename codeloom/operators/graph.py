"""A property graph as tables of nodes and edges: building it from symbols and source files, looking things up in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("


def edges_of(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct u, v without loops and nulls."""
    return df.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()


def containment(symbols: DataFrame) -> DataFrame:
    """src, dst and type of the tree repository, file, class, method and function."""
    s = symbols.where("symbol_name is not null")
    file = F.concat_ws(":", F.lit("file"), "repo_id", "file_path")
    kinds = F.lower("symbol_type")
    node = F.concat_ws(":", F.when(kinds.isin("class", "struct", "interface"), "class").otherwise("func"), "repo_id", "file_path", "symbol_id")
    parent = F.concat_ws(":", F.lit("class"), "repo_id", "file_path", "parent_symbol_id")
    contains = s.select(F.concat(F.lit("repo:"), "repo_id").alias("src"), file.alias("dst"), F.lit("CONTAINS").alias("type"))
    declares = s.select(F.when(F.col("parent_symbol_id").isNotNull(), parent).otherwise(file).alias("src"), node.alias("dst"), F.when(F.col("parent_symbol_id").isNotNull(), "HAS_METHOD").when(kinds.isin("class", "struct", "interface"), "DECLARES").otherwise("DECLARES_FUNC").alias("type"))
    return contains.unionByName(declares).distinct()


def calls(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo_id, caller_path, callee and callee_path: names called in a file that a file of the repository declares, one row for each that does."""
    made = files.select("repo_id", F.col("file_path").alias("caller_path"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(CALL), 1))).alias("callee")).distinct()
    known = symbols.where(F.lower("symbol_type").isin("function", "method") & F.col("symbol_name").isNotNull()).select("repo_id", F.col("symbol_name").alias("callee"), F.col("file_path").alias("callee_path")).distinct()
    return made.join(known, ["repo_id", "callee"])


def neighbours(edges: DataFrame, nodes: DataFrame, key: str, name: str, reverse: bool = False) -> DataFrame:
    """name and other_name of edges with the names of both ends; reverse: callers rather than callees."""
    a = nodes.select(F.col(key).alias("u"), F.col(name).alias("name"))
    b = nodes.select(F.col(key).alias("v"), F.col(name).alias("other_name"))
    both = edges.join(a, "u").join(b, "v")
    return both.select(F.col("other_name").alias("name"), F.col("name").alias("other_name")) if reverse else both.select("name", "other_name")


def degrees(edges: DataFrame) -> DataFrame:
    """node with out_degree, in_degree and degree."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def score_nodes(nodes: DataFrame, terms: Sequence[str], label: str, source: str) -> Column:
    """1 for each term in the label and a half for each in the source."""
    total = F.lit(0.0)
    for t in (t.lower() for t in terms if len(t) > 2):
        total = total + F.contains(F.lower(label), F.lit(t)).cast("int") + 0.5 * F.contains(F.lower(source), F.lit(t)).cast("int")
    return total


def last_per_pair(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """One edge for each u, v: the last in order, whose attributes replace those of the ones before."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.groupBy("u", "v").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select("u", "v", "row.*")


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, path: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of some files and the edges at either end of them."""
    left = nodes.join(files.select(path).distinct(), path, "left_anti")
    ids = left.select("id")
    return left, edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select(*edges.columns)


def diff(old: DataFrame, new: DataFrame, directed: bool = True) -> DataFrame:
    """change, u, v of the edges that only one of two graphs has."""
    canon = (lambda e: e.select("u", "v").distinct()) if directed else (lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    a, b = canon(old), canon(new)
    return a.join(b, ["u", "v"], "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, ["u", "v"], "left_anti").withColumn("change", F.lit("added")))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of JSON, kind and value, which node_link reads; no node or edge gathers with others."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("value")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("value")))


def cypher(nodes: DataFrame, kind: str, key: str) -> DataFrame:
    """A statement for each node; quotes and backslashes are escaped, other characters than letters and digits leave the label."""
    quoted = F.regexp_replace(F.regexp_replace(F.col(key).cast("string"), r"\\", r"\\\\"), "'", r"\\'")
    return nodes.select(F.concat(F.lit("MERGE (n:"), F.regexp_replace(F.coalesce(F.col(kind), F.lit("Node")), r"[^A-Za-z0-9_]", ""), F.lit(" {id: '"), quoted, F.lit("'});")).alias("statement"))


def attach(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new whose key it lacks; of equal keys in new the first in order of all columns."""
    w = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    return old.unionByName(new.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth").join(old.select(key), key, "left_anti"))


def graphml(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """line: the elements of a GraphML document, for a writer to put between its head and foot; nodes without a community have -1."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    community = F.coalesce(F.col("community"), F.lit(-1)).cast("string") if "community" in nodes.columns else F.lit("-1")
    out = nodes.select(F.concat(F.lit('<node id="'), escaped(key), F.lit('"><data key="community">'), community, F.lit("</data></node>")).alias("line"))
    return out.unionByName(edges.select(F.concat(F.lit('<edge source="'), escaped("u"), F.lit('" target="'), escaped("v"), F.lit('"/>')).alias("line")))


def lookup(symbols: DataFrame, kind: str, pattern: str = "") -> DataFrame:
    """The graph's standing questions: files, classes, functions or symbol, whose path or name holds a text in any case; no rows for another kind."""
    holds = lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))
    types = F.lower("symbol_type")
    if kind == "files":
        return symbols.where(F.contains("file_path", F.lit(pattern))).select("repo_id", "file_path", F.lit(None).cast("string").alias("symbol_name")).distinct()
    wanted = {"classes": types.isin("class", "interface", "struct"), "functions": types.isin("function", "method"), "symbol": F.lit(True)}.get(kind, F.lit(False))
    return symbols.where(wanted & holds("symbol_name")).select("repo_id", "file_path", "symbol_name").distinct()
