"""Queries over stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import filters, vectors
from codeloom.storage import table


def _vectors(e: DataFrame, *ids: int) -> list[list[float]]:
    """The stated query vectors; few, and told by their ids."""
    rows = {r["vec_id"]: list(r["embedding"]) for r in e.where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()}
    return [rows[i] for i in ids if i in rows]


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def q_vec_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _score(vectors.top_k(e, _vectors(e, 0)[0], 10, "vec_id")).select("vec_id", "label", "score")


def q_vec_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _score(vectors.top_k(e, _vectors(e, 0)[0], 10, "vec_id", scope=F.col("label").isin(1, 3, 5))).select("vec_id", "label", "score")


def q_vec_threshold_post(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _score(vectors.top_k(e, _vectors(e, 0)[0], 20, "vec_id", min_score=0.3)).select("vec_id", "label", "score")


def q_vec_multi_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _score(vectors.multi_query(e, _vectors(e, 0, 1, 2), 25, "vec_id", ["vec_id"], min_score=0.1)).select("vec_id", F.col("q_idx").cast("int").alias("q_idx"), "score")


def q_vec_best_per_label(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = _vectors(e, 0)[0]
    hits = e.withColumn("score", 1 - vectors.cosine_distance(F.col("embedding"), vectors.literal(q)))
    return _score(vectors.best_per_key(hits, "label", "score", ["vec_id"]).orderBy(F.desc("score"), "label").limit(5)).select("label", "vec_id", "score")


def q_hybrid_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the files that a structural filter selects, each with its similarity to its file's first chunk."""
    chunks = table(spark, d, "code_chunks").where("embedding is not null and size(embedding) = 64 and forall(embedding, x -> not isnan(x)) and exists(embedding, x -> x <> 0)")
    files = filters.structure(table(spark, d, "symbols"), suffixes=(".go", ".java"), classes=("s",), mode="documented")
    hits = vectors.in_files(chunks.select("row_id", "repo_id", "file_path", "start_line", "embedding"), files)
    first = hits.groupBy("repo_id", "file_path").agg(F.min_by("embedding", F.struct("start_line", "row_id")).alias("q"))
    return _score(hits.join(first, ["repo_id", "file_path"]).withColumn("score", 1 - vectors.cosine_distance(F.col("embedding"), F.col("q")))).select("row_id", "score")


QUERIES = {f.__name__: f for f in (q_vec_topk, q_vec_topk_scoped, q_vec_threshold_post, q_vec_multi_query, q_vec_best_per_label, q_hybrid_files)}

_D = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
ORACLE = {
    "q_vec_topk": f"select e.vec_id, e.label, round({_D}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q order by 1 - {_D}, e.vec_id limit 10",
    "q_vec_topk_scoped": f"select e.vec_id, e.label, round({_D}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label in (1, 3, 5) order by 1 - {_D}, e.vec_id limit 10",
    "q_vec_threshold_post": f"with t as (select e.vec_id, e.label, {_D} as s from embeddings e, (select embedding from embeddings where vec_id = 0) q order by 1 - {_D}, e.vec_id limit 20) select vec_id, label, round(s, 6) as score from t where 1 - s < 0.7",
    "q_vec_multi_query": f"""
        with h as (select q.vec_id as q_idx, e.vec_id, {_D} as s from embeddings e, (select * from embeddings where vec_id in (0, 1, 2)) q),
        r as (select *, row_number() over (partition by q_idx order by 1 - s, vec_id) as rank from h),
        f as (select *, row_number() over (partition by vec_id order by q_idx, rank) as nth from r where rank <= 50)
        select vec_id, q_idx::integer as q_idx, round(s, 6) as score from f where nth = 1 and s >= 0.1 order by s desc, q_idx, rank limit 25""",
    "q_vec_best_per_label": f"""
        with h as (select e.label, e.vec_id, {_D} as s from embeddings e, (select embedding from embeddings where vec_id = 0) q),
        r as (select *, row_number() over (partition by label order by s desc, vec_id) as nth from h)
        select label, vec_id, round(s, 6) as score from r where nth = 1 order by s desc, label limit 5""",
    "q_hybrid_files": f"""
        with f as (select distinct repo_id, file_path from (select repo_id, file_path, bool_or(file_path like '%.go' or file_path like '%.java') as a, bool_or(coalesce(lower(symbol_type) in ('class', 'interface', 'struct') and contains(lower(symbol_name), 's'), false)) as b from symbols group by 1, 2) where a and b),
        h as (select row_id, repo_id, file_path, start_line, embedding from code_chunks c where embedding is not null and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: isnan(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
              and exists (select 1 from f where f.repo_id = c.repo_id and (f.file_path = c.file_path or ends_with(c.file_path, '/' || f.file_path)))),
        q as (select repo_id, file_path, arg_min(embedding, (start_line, row_id)) as embedding from h group by 1, 2)
        select e.row_id, round({_D}, 6) as score from h e join q using (repo_id, file_path)""",
}
