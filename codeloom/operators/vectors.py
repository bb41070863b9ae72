"""Search by cosine over stored vectors: top-k, scopes, thresholds, several queries, hybrid with candidate files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, query: Column | Sequence[float], k: int, key: str, embedding: str = "embedding", min_score: float | None = None, scope: Column | None = None) -> DataFrame:
    """The k rows nearest to query with distance and score, ties by key.

    scope filters before the search. min_score filters after the limit, strictly, so that fewer than k
    rows may be left. Rows whose vector is null, empty or zero have no distance and are left out.
    """
    q = query if isinstance(query, Column) else literal(query)
    rows = df if scope is None else df.where(scope)
    near = rows.withColumn("distance", cosine_distance(F.col(embedding), q)).where("distance is not null").orderBy("distance", key).limit(k)
    if min_score is not None:
        near = near.where(F.col("distance") < 1 - min_score)
    return near.withColumn("score", 1 - F.col("distance"))


def multi_query(df: DataFrame, queries: Sequence[Sequence[float]], k: int, key: str, dedup: Sequence[str], min_score: float = 0.0, embedding: str = "embedding", over: int = 2) -> DataFrame:
    """The best k of several queries, merged; q_idx is a query's number from 0.

    Each query fetches over * k rows; of rows with equal dedup columns the one of the first query, and
    in it the nearest, is kept with its score; then the threshold (inclusive) and the limit. queries is
    a stated set, sent to every block of df; ranks are limited before rows are brought together.
    """
    each = df.select("*", F.posexplode(F.array(*[literal(q) for q in queries])).alias("q_idx", "q_vec"))
    scored = each.withColumn("distance", cosine_distance(F.col(embedding), F.col("q_vec"))).where("distance is not null").drop("q_vec")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_idx").orderBy("distance", key))).where(F.col("rank") <= over * k)
    first = ranked.withColumn("nth", F.row_number().over(Window.partitionBy(*dedup).orderBy("q_idx", "rank"))).where("nth = 1")
    out = first.withColumn("score", 1 - F.col("distance")).where(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "q_idx", "rank").limit(k)


def best_per_key(hits: DataFrame, key: str, score: str, order: Sequence[str]) -> DataFrame:
    """The row of the highest score of each key, the first in order among equals."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *order)
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def in_files(hits: DataFrame, candidates: DataFrame, path: str = "file_path", scope: str = "repo_id") -> DataFrame:
    """The hits whose path ends with the path of a candidate file of the same repository, at a directory's border.

    Candidates without a column scope stand for files of any repository. Every suffix of a hit's path
    is looked up, so that the join is on equality.
    """
    same = [scope] if scope in candidates.columns else []
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    wanted = candidates.select(*same, F.col(path).alias("tail")).distinct()
    paths = hits.select(*same, path).where(F.col(path).isNotNull()).distinct().select(*same, path, F.explode(tails).alias("tail"))
    return hits.join(paths.join(wanted, [*same, "tail"], "left_semi").select(*same, path).distinct(), [*same, path], "left_semi").select(*hits.columns)


def embed(texts: Column, width: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of length one."""

    @F.pandas_udf("array<float>")
    def run(s):  # type: ignore[no-untyped-def]
        import re
        import zlib

        import numpy as np

        def one(text):  # type: ignore[no-untyped-def]
            v = np.zeros(width)
            for w in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype("float32").tolist()

        return s.map(one)

    return run(texts)
