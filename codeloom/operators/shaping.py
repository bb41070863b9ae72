"""Shaping of rows for lists, prompts and reports: paths, ranks, totals, joins that fill in, and predicates of graph nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.filters import base_name

# Fixed value: the paths of test files, whatever their case.
TEST_FILES = r"(?i)(^|/)tests?/|/test_[^/]+$|/_test\.py$|/conftest\.py$|/testing/|\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts|jsx|tsx)$|__tests__/"


def test_file(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_FILES), F.lit(False))


test_file.__test__ = False  # type: ignore[attr-defined]


def top_directory(path: Column) -> Column:
    """The first part of a path, or the name of a file at the top."""
    return F.split(path, "/")[0]


def below_repository(path: Column, prefix: str) -> Column:
    """A path without a prefix and the two directories behind it; others stay."""
    return F.regexp_replace(path, "^" + prefix.rstrip("/") + "/[^/]+/[^/]+/", "")


def checkout_name(path: Column) -> Column:
    """The directory above a checkout's last, which names the repository, or the last where that is repos."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.when(above.isNull() | (above == "repos"), F.element_at(parts, -1)).otherwise(above)


def checkout_branch(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def words_to_tokens(words: Column) -> Column:
    return F.floor(words * 100 / 75).cast("bigint")


# --------------------------------------------------------------------------- nodes of a graph


def hub(label: Column, source: Column, degree: Column) -> Column:
    """A file's own node, a method's stub, or a function that only its file leads to."""
    stub = F.startswith(label, F.lit(".")) & F.endswith(label, F.lit("()"))
    file = (source != "") & (label == base_name(source))
    return F.coalesce(label != "", F.lit(False)) & (F.coalesce(file, F.lit(False)) | stub | (F.endswith(label, F.lit("()")) & (degree <= 1)))


def concept(source: Column) -> Column:
    """A node of no file: its source is empty or has no extension."""
    return F.coalesce(source, F.lit("")).rlike(r"^$|(^|/)[^./]*$")


def god_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of the greatest degree that are entities: no hubs, stubs or concepts. nodes has node, label, source and degree."""
    real = nodes.where(~hub(F.col("label"), F.col("source"), F.col("degree")) & ~concept(F.col("source")))
    return real.orderBy(F.desc("degree"), "node").limit(n).select("node", "label", "degree")


def dominant(edges: DataFrame, value: str, order: Sequence[str], otherwise: str) -> DataFrame:
    """node and the value that most of its edges u, v have, of equals the one met first in order; otherwise where it is null."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), F.coalesce(value, F.lit(otherwise)).alias(value), F.struct(*order).alias("at"))
    votes = ends.groupBy("node", value).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return votes.groupBy("node").agg(F.min_by(value, F.struct(-F.col("n"), "at")).alias(value))


def ordered_communities(labels: DataFrame) -> DataFrame:
    """community_no, n_nodes, community and first: communities numbered from 0 by falling size, then by their least node."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node").alias("first"))
    return sizes.withColumn("community_no", F.row_number().over(Window.orderBy(F.desc("n_nodes"), "first")) - 1)


def as_text(nodes: DataFrame, edges: DataFrame, tokens: int = 2000) -> DataFrame:
    """One row: a subgraph as lines, nodes by falling degree, then edges, cut at about three characters a token.

    For the neighbourhood that one answer is given from, which walks bound; nodes has node, label,
    source, community and degree, edges u, v, relation and confidence.
    """
    name = lambda k: nodes.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    first = nodes.select(F.lit(0).alias("part"), (-F.col("degree")).alias("by"), F.col("node").cast("string").alias("key"), F.format_string("NODE %s [src=%s community=%s]", "label", "source", "community").alias("line"))
    second = edges.join(name("u"), "u").join(name("v"), "v").select(F.lit(1).alias("part"), F.lit(0).alias("by"), F.concat_ws(" ", "u", "v", "relation").alias("key"), F.format_string("EDGE %s --%s [%s]--> %s", "u_label", "relation", "confidence", "v_label").alias("line"))
    lines = first.unionByName(second).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "by", "key", "line"))), lambda x: x.line), "\n").alias("text"))
    cut = F.concat(F.substring("text", 1, 3 * tokens), F.lit(f"\n... (truncated to ~{tokens} token budget)"))
    return lines.select(F.when(F.length("text") > 3 * tokens, cut).otherwise(F.col("text")).alias("text"))


# --------------------------------------------------------------------------- joins that mend and fill in


def without(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows whose key is none of the values: NOT IN, but nulls among the values say nothing, and a null key is none of them."""
    return df.join(values.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def filled(df: DataFrame, more: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with the values of more, of which key is unique, where its own are null or empty."""
    other = more.select(key, *[F.col(c).alias(f"more_{c}") for c in columns])
    own = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return df.join(other, key, "left").select(*[F.coalesce(own(c), F.col(f"more_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def known_names(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """The rows whose name, in whatever case, is a known one."""
    key = F.lower(F.trim(F.col(name)))
    return df.withColumn("__key", key).join(known.select(key.alias("__key")).distinct(), "__key", "left_semi").drop("__key")


def reranked(df: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """The rows that scores names, with its scores in place of their own, and their rank from 1."""
    out = df.drop(score).join(scores.select(key, score), key)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def contained_names(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """key and other: for each row of left the row of right, first by name, whose name holds its own or is held by it, but for case, _ and -.

    Every substring of a name is looked up, so that the join is on equality; names are short.
    """
    plain = F.regexp_replace(F.lower(name), "[_-]", "")
    a = left.select(key, plain.alias("plain")).where("plain <> ''")
    b = right.select(F.col(key).alias("other"), plain.alias("plain"), F.col(name).alias("other_name")).where("plain <> ''")
    n = F.length("plain")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("plain", i, k)))))
    within = a.select(key, "plain").join(b.select("other", "other_name", F.explode(parts).alias("plain")), "plain")
    around = a.select(key, F.explode(parts).alias("plain")).join(b, "plain")
    both = within.select(key, "other", "other_name").union(around.select(key, "other", "other_name"))
    return both.groupBy(key).agg(F.min_by("other", F.struct("other_name", "other")).alias("other"))


# --------------------------------------------------------------------------- totals


def overflow(df: DataFrame, running: str, budget: int, path: str) -> DataFrame:
    """One row: how many rows lie beyond the budget, from how many files, and the sentence that says so, empty if none."""
    out = df.where(F.col(running) > budget).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(path, F.lit(""))).alias("n_files"))
    said = F.format_string("\n[%d additional chunks from %d files were not included due to context limits]", "n", "n_files")
    return out.withColumn("summary", F.when(F.col("n") > 0, said).otherwise(""))


def trimmed(df: DataFrame, by: Sequence[str], text: str, budget: int) -> DataFrame:
    """The texts of each group cut in proportion to their lengths, so that together they have at most budget characters."""
    total = F.sum(F.length(text)).over(Window.partitionBy(*by))
    keep = F.when(total > budget, F.floor(F.length(text) * F.lit(budget) / total).cast("int")).otherwise(F.length(text))
    return df.withColumn(text, F.col(text).substr(F.lit(1), keep))


def reduction(per_query: DataFrame, corpus_words: int | Column) -> DataFrame:
    """One row: tokens of the corpus, the mean tokens of queries that found any, rounded down, and how many times fewer these are."""
    words = (F.lit(corpus_words) if isinstance(corpus_words, int) else corpus_words).cast("bigint")
    out = per_query.where("tokens > 0").agg(F.floor(F.sum("tokens") / F.count(F.lit(1))).cast("bigint").alias("avg_query_tokens"))
    out = out.withColumn("corpus_tokens", words_to_tokens(words))
    return out.withColumn("ratio", F.when(F.col("avg_query_tokens") > 0, F.round(F.col("corpus_tokens") / F.col("avg_query_tokens"), 1)).otherwise(0.0))
