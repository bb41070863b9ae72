"""The queries of the numbered problems, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import docpairs, neardup, neighbours, packing, parsing, provenance, secrets, splitting, tokens, truncation
from codeloom.llm.base import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.extract(table(spark, d, "source_files")).select("repo_id", "file_path", "symbol_name", "start_line").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.extract(table(spark, d, "source_files")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "code_chunks")).select("row_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "code_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_long(table(spark, d, "code_chunks")).select("row_id", F.explode(F.array(F.lit(0), "cut_line")).alias("line_no"))
    return cut.distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "code_chunks"))


def p3_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of each row: whether no piece is too long, each stands where it says, and together they leave nothing out."""
    rows = table(spark, d, "code_chunks").where("chunk_text is not null").select("row_id", F.col("chunk_text").alias("text"))
    cut = splitting.split(table(spark, d, "code_chunks")).join(rows, "row_id")
    end = F.col("start_char") + F.length("chunk_text")
    placed = cut.select("row_id", F.length("text").alias("n_chars"), "start_char", end.alias("end_char"), (F.length("chunk_text") <= 2048).alias("short"), F.col("text").substr(F.col("start_char") + 1, F.length("chunk_text")).eqNullSafe(F.col("chunk_text")).alias("there"))
    spans = placed.groupBy("row_id", "n_chars").agg(F.bool_and("short").alias("within"), F.bool_and("there").alias("there"), F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("s"))
    step = lambda reached, x: F.when(x.start_char <= reached, F.greatest(reached, x.end_char)).otherwise(reached)
    return spans.select("row_id", "n_chars", "within", (F.col("there") & (F.aggregate("s", F.lit(0), step) == F.col("n_chars"))).alias("whole"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar(table(spark, d, "code_chunks")).select("hash_a", "hash_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunks")
    return neardup.groups(chunks, neardup.similar(chunks))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(table(spark, d, "code_chunks")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "code_chunks"), table(spark, d, "upstream_files")).where("not by_hand").select("repo_id", "file_path")


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository with jobs: its files, and those that were written by hand."""
    of = provenance.classify(table(spark, d, "code_chunks"), table(spark, d, "upstream_files"))
    repos = table(spark, d, "jobs").where("repo_id is not null").select("repo_id").distinct()
    return of.join(repos, "repo_id", "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("by_hand").alias("n_by_hand"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.found(table(spark, d, "source_files"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(table(spark, d, "source_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: whether its parts follow one another, only parts of oversized texts are apart, and no container of theirs is too full."""
    packed = written(packing.pack(table(spark, d, "documents"), F.col("doc_id"), F.col("text")))
    sizes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("size"))
    rows = packed.join(sizes, "container_id", "left")
    follow = (F.max("part") == F.count(F.lit(1))) & (F.sum("n_tokens") == F.max(F.col("first_token") + F.col("n_tokens"))) & ((F.max("part") == 1) | (F.sum("n_tokens") > 2048))
    return rows.groupBy("doc_id").agg((follow & (F.max(F.coalesce("size", F.lit(0))) <= 2048)).alias("whole"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.scored(table(spark, d, "documents")).where("score >= 0.5").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.scored(table(spark, d, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_redacted, p3_found, p3_pieces, p3_covered, p4_found, p4_groups, p5_found, p6_found, p6_kept, p7_found, p7_rates, p8_ids, p9_containers, p9_checked, p10_found, p10_rates)}

ORACLE: dict[str, str] = {
    "p3_covered": "select row_id, length(chunk_text)::integer as n_chars, true as within, true as whole from code_chunks where chunk_text is not null",
    "p9_checked": "select doc_id, true as whole from documents",
    "p3_found": r"""
        with c as (select row_id, chunk_text from code_chunks where length(chunk_text) > 2048),
        l as (select row_id, unnest(range(1, len(string_split(chunk_text, chr(10))) + 1)) as line_no, unnest(string_split(chunk_text, chr(10))) as line from c)
        select row_id, 0::integer as line_no from c
        union
        select row_id, line_no::integer from l where length(case when right(line, 1) = chr(13) then left(line, length(line) - 1) else line end) > 2048
    """,
}
