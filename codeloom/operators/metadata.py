"""Jobs, manifests, interactions and sessions: counts, latest rows, histories, matches of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status_counts(df: DataFrame, status: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def latest(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order; partial results are limited before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth = 1").drop("nth")


def newest_per_origin(manifests: DataFrame) -> DataFrame:
    """The last indexed manifest of each repository, known by its URL or else its path."""
    origin = F.coalesce(F.when(F.col("repo_url") != "", F.col("repo_url")), F.col("repo_path"))
    return latest(manifests.withColumn("origin", origin), ["origin"], [F.desc_nulls_last("last_indexed_at"), F.desc("repo_id")])


def oldest_waiting(jobs: DataFrame, by: Sequence[str] = (), status: str = "pending") -> DataFrame:
    """The job to claim next, of each group: first come, first served, ties by id."""
    waiting = jobs.where(F.col("status") == status)
    if by:
        return latest(waiting, by, [F.asc("created_at"), F.asc("id")])
    return waiting.orderBy("created_at", "id").limit(1)


def history(df: DataFrame, by: str, order: Sequence[str], last: int, always: Column) -> DataFrame:
    """The last rows of each group and those that always stay."""
    newest = F.row_number().over(Window.partitionBy(by, always).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("nth", newest).where(always | (F.col("nth") <= last)).drop("nth")


def recent_groups(df: DataFrame, by: str, when: str, keep: int) -> DataFrame:
    """The groups that were last active, as many as are kept."""
    return df.groupBy(by).agg(F.max(when).alias("last_active"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_active"), by).limit(keep)


def running_count(df: DataFrame, by: str, order: Sequence[str], most: int) -> DataFrame:
    """used and allowed: how often a group has used a budget so far, and whether it still might."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("used") <= most)


def contributors(df: DataFrame, by: str, who: str, when: str, key: str, last: int = 4) -> DataFrame:
    """Of each group: rows, distinct contributors, the first with its time, and the last few distinct ones, newest first."""
    per = df.where(F.col(who).isNotNull()).groupBy(by, who).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(when, key)).alias("latest"), F.min(F.struct(when, key)).alias("earliest"))
    recent = per.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("latest"), who)))
    return recent.groupBy(by).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_contributors"),
        F.min_by(who, "earliest").alias("first_contributor"),
        F.min(F.col("earliest").getField(when)).alias("first_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= last, F.struct("nth", who)))), lambda x: x[who]), ",").alias("recent"),
    )


def leaderboard(df: DataFrame, who: str) -> DataFrame:
    counts = df.where(F.col(who).isNotNull()).groupBy(who).agg(F.count(F.lit(1)).alias("n"))
    ranks = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))  # few rows: one for each count
    above = ranks.withColumn("before", F.sum("m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)))
    return counts.join(above.select("n", F.coalesce("before", F.lit(0)).alias("before")), "n").select(who, "n", (F.col("before") + 1).alias("rank"))


def name_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def overlap_matches(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, least: float) -> DataFrame:
    """The best match of each left name among the right ones by the share of its words found, at least least; ties by right_key.

    Names meet over shared words (an inverted index), never each with every other. A match shares at
    least the rounded-up part least of a name's n words, hence one of its n - that + 1 rarest, and only
    these are looked up.
    """
    l = left.select(F.col(left_key).alias("l"), name_words(F.col(left_text)).alias("lw")).where(F.size("lw") > 0)  # noqa: E741
    r = right.select(F.col(right_key).alias("r"), name_words(F.col(right_text)).alias("rw")).where(F.size("rw") > 0)
    index = r.select("r", F.explode("rw").alias("w"))
    rare = l.select("l", F.size("lw").alias("n"), F.explode("lw").alias("w")).join(index.groupBy("w").agg(F.count(F.lit(1)).alias("f")), "w", "left").fillna(0, ["f"])
    nth = F.row_number().over(Window.partitionBy("l").orderBy("f", "w"))
    looked = rare.withColumn("nth", nth).where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & (F.col("f") > 0)).select("l", "w")
    met = looked.join(index, "w").select("l", "r").distinct().join(l, "l").join(r, "r")
    scored = met.select("l", "r", (F.size(F.array_intersect("lw", "rw")) / F.size("lw")).alias("score")).where(F.col("score") >= least)
    return latest(scored, ["l"], [F.desc("score"), F.asc("r")]).select(F.col("l").alias(left_key), F.col("r").alias("matched"), "score")


def keyword_score(queries: Sequence[Sequence[str]], text: Column, least: float = 0.1) -> Column:
    """Half of the greatest share of a query's words that the text holds; null below least."""
    low = F.lower(text)
    shares = [sum((F.contains(low, F.lit(w.lower())).cast("int") for w in q), F.lit(0)) / len(q) for q in queries if q]
    score = 0.5 * (F.greatest(*shares) if len(shares) > 1 else shares[0])
    return F.when(score >= least, score)


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_null and n_empty of each column."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c).cast("string") == "").alias("n_empty")).alias(c) for c in columns])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in columns])).alias("y")).select("y.column_name", F.col("n").alias("n_rows"), "y.x.n_null", "y.x.n_empty")


def first_source(frames: Sequence[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """The union of frames of one schema, of each key the row of the first frame that has it, ties by all columns; limit keeps the first keys by frame and key."""
    rows = None
    for i, f in enumerate(frames):
        one = f.withColumn("source_no", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    out = latest(rows, [key], [F.asc("source_no"), *[F.asc(c) for c in frames[0].columns if c != key]])
    return (out if limit is None else out.orderBy("source_no", key).limit(limit)).drop("source_no")


def json_names(text: Column) -> Column:
    """The names in a JSON list of texts or of objects with a name; empty for null and for what is no such list."""
    texts = F.from_json(text, "array<string>")
    named = F.transform(texts, lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    return F.coalesce(F.filter(named, lambda x: x.isNotNull()), F.array().cast("array<string>"))
