"""Queries over jobs, manifests, interactions, symbols and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import storage
from codeloom.operators import metadata, snapshots
from codeloom.storage import table

STATUSES = ["pending", "running", "completed", "failed", "cancelled"]


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each job."""
    return metadata.latest(table(spark, d, "jobs"), ["id"], [F.desc("updated_at"), F.desc_nulls_last("progress"), F.desc("status")])


def q_job_stats(spark: SparkSession, d: str) -> DataFrame:
    return metadata.status_counts(_jobs(spark, d), "status", STATUSES, ["org"])


def q_job_latest(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("id", "status", "progress", "updated_at")


def q_job_claim_fifo(spark: SparkSession, d: str) -> DataFrame:
    return metadata.oldest_waiting(_jobs(spark, d), ["org"]).select("org", "id", "created_at")


def q_visibility(spark: SparkSession, d: str) -> DataFrame:
    j = _jobs(spark, d)
    return j.where(metadata_visible(j)).select("id", "user_id", "status")


def metadata_visible(j: DataFrame):  # type: ignore[no-untyped-def]
    from codeloom.operators.filters import visible

    return visible(F.col("user_id"), "u-ralorquinbo", public=F.col("branch") != "main")


def q_manifest_newest(spark: SparkSession, d: str) -> DataFrame:
    return metadata.newest_per_origin(table(spark, d, "repository_manifests")).select("origin", "repo_id", "last_indexed_at")


def q_manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    """The stored number of files of each repository beside the numbers of files and chunks there are."""
    m = table(spark, d, "repository_manifests").select("repo_id", "total_files_indexed")
    c = table(spark, d, "code_chunks").groupBy("repo_id").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("chunk_id").alias("n_chunks"))
    return m.join(c, "repo_id", "left").select("repo_id", "total_files_indexed", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def q_repo_overview(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with a manifest, and those that only jobs name."""
    m = table(spark, d, "repository_manifests").select("repo_id", "branch", F.lit("manifest").alias("origin"))
    j = metadata.latest(_jobs(spark, d).where("repo_id is not null"), ["repo_id"], [F.desc("updated_at"), F.desc("id")])
    return m.unionByName(j.select("repo_id", "branch", F.lit("job").alias("origin")).join(m, "repo_id", "left_anti"))


def q_contributors(spark: SparkSession, d: str) -> DataFrame:
    return metadata.contributors(table(spark, d, "events"), "event_type", "user_id", "ts", "event_id")


def q_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return metadata.leaderboard(table(spark, d, "events"), "user_id")


def q_interactions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


def q_sessions_recent(spark: SparkSession, d: str) -> DataFrame:
    return metadata.recent_groups(table(spark, d, "events"), "user_id", "ts", 100)


def q_session_history(spark: SparkSession, d: str) -> DataFrame:
    return metadata.history(table(spark, d, "events"), "user_id", ["ts", "event_id"], 4, F.col("event_type") == "error").select("event_id", "user_id", "event_type")


def q_running_budget(spark: SparkSession, d: str) -> DataFrame:
    return metadata.running_count(table(spark, d, "events"), "user_id", ["ts", "event_id"], 20).select("event_id", "used", "allowed")


def q_last_status(spark: SparkSession, d: str) -> DataFrame:
    return metadata.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts")


def q_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events, a quiet time of five minutes apart."""
    from codeloom.streaming.feeds import bursts

    return bursts(table(spark, d, "events"), "ts", "5 minutes", ["user_id"]).select("user_id", "started", F.col("n").alias("n_events"))


def q_symbol_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols")
    old, new = s.where("commit_sha is null"), s.where("commit_sha is not null")
    last = metadata.latest(new, ["symbol_id"], [F.desc("commit_sha"), F.desc("start_line"), F.desc("end_line")])
    return storage.replace_files(old, last).select("symbol_id", "repo_id", "file_path", "start_line")


def q_sparse_update(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "repository_manifests").select("repo_id", "branch", "org", "repo_url")
    patch = metadata.latest(_jobs(spark, d).where("repo_id is not null"), ["repo_id"], [F.desc("updated_at"), F.desc("id")]).select("repo_id", "branch", "org", "repo_url")
    return storage.sparse_update(m, patch, ["repo_id"])


def q_file_purge(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "ast_results").where("success = false")
    return storage.delete_files(table(spark, d, "code_chunks").select("row_id", "repo_id", "file_path"), gone)


def q_null_audit(spark: SparkSession, d: str) -> DataFrame:
    return metadata.null_audit(table(spark, d, "code_chunks"), ["chunk_text", "symbol_name", "language", "docstring", "embedding_version"])


def q_vector_widths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").groupBy(F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(-1)).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def _version(spark: SparkSession, d: str, version: int) -> DataFrame:
    c = table(spark, d, "code_chunks").where(F.col("embedding_version") == version)
    return c.groupBy("repo_id", "file_path").agg(F.min("chunk_hash").alias("content_hash"))


def q_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first and the second version of the index, by the least hash of their chunks."""
    return snapshots.changes(_version(spark, d, 1), _version(spark, d, 2), ["repo_id", "file_path"])


def q_hash_antijoin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks")
    return snapshots.unseen(c.where("embedding_version = 2"), c.where("embedding_version = 1")).select("row_id")


def q_touched(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by the time of their last scan, against what the manifests say."""
    old = table(spark, d, "repository_manifests").select("repo_id", F.col("last_indexed_at").alias("at"))
    new = table(spark, d, "source_files").groupBy("repo_id").agg(F.max("scanned_at").alias("at"))
    return snapshots.touched(old, new, "repo_id", "at")


def q_manifest_authors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "repository_manifests")
    return m.select("repo_id", F.explode(metadata.json_names(F.col("last_authors"))).alias("author")).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        q_manifest_authors, q_job_stats, q_job_latest, q_job_claim_fifo, q_visibility, q_manifest_newest, q_manifest_totals, q_repo_overview, q_contributors, q_leaderboard, q_interactions, q_sessions_recent, q_session_history,
        q_running_budget, q_last_status, q_debounce, q_symbol_upsert, q_sparse_update, q_file_purge, q_null_audit, q_vector_widths, q_snapshot_diff, q_hash_antijoin, q_touched,
    )
}

_JOBS = "jl as (select * exclude (nth) from (select *, row_number() over (partition by id order by updated_at desc nulls last, progress desc nulls last, status desc nulls last) as nth from jobs) where nth = 1)"
_LAST_JOB = "lj as (select * exclude (nth) from (select *, row_number() over (partition by repo_id order by updated_at desc nulls last, id desc) as nth from jl where repo_id is not null) where nth = 1)"
_V = "(select repo_id, file_path, min(chunk_hash) as h from code_chunks where embedding_version = {} group by 1, 2)"
ORACLE = {
    "q_manifest_authors": "select author, count(*) as n from (select unnest(from_json(last_authors, '[\"varchar\"]')) as author from repository_manifests where last_authors is not null) group by 1",
    "q_job_stats": f"with {_JOBS} select org, count(*) as total, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in STATUSES) + " from jl group by org",
    "q_job_latest": f"with {_JOBS} select id, status, progress, updated_at from jl",
    "q_job_claim_fifo": f"with {_JOBS} select org, id, created_at from (select *, row_number() over (partition by org order by created_at nulls first, id) as n from jl where status = 'pending') where n = 1",
    "q_visibility": f"with {_JOBS} select id, user_id, status from jl where user_id is null or user_id = 'u-ralorquinbo' or branch <> 'main'",
    "q_manifest_newest": "select origin, repo_id, last_indexed_at from (select *, row_number() over (partition by origin order by last_indexed_at desc nulls last, repo_id desc) as n from (select *, coalesce(nullif(repo_url, ''), repo_path) as origin from repository_manifests)) where n = 1",
    "q_manifest_totals": "select m.repo_id, m.total_files_indexed, coalesce(c.f, 0) as n_files, coalesce(c.k, 0) as n_chunks from repository_manifests m left join (select repo_id, count(distinct file_path) as f, count(distinct chunk_id) as k from code_chunks group by 1) c using (repo_id)",
    "q_repo_overview": f"with {_JOBS}, {_LAST_JOB} select repo_id, branch, 'manifest' as origin from repository_manifests union all select repo_id, branch, 'job' as origin from lj where repo_id not in (select repo_id from repository_manifests)",
    "q_contributors": """
        with p as (select event_type, user_id, count(*) as n, max((ts, event_id)) as latest, min((ts, event_id)) as earliest, min(ts) as first_ts from events where user_id is not null group by 1, 2),
        r as (select *, row_number() over (partition by event_type order by latest desc, user_id) as nth from p)
        select event_type, sum(n)::bigint as n_rows, count(*) as n_contributors, arg_min(user_id, earliest) as first_contributor, min(first_ts) as first_at,
               string_agg(user_id::varchar, ',' order by nth) filter (nth <= 4) as recent from r group by 1""",
    "q_leaderboard": "select user_id, n, rank() over (order by n desc) as rank from (select user_id, count(*) as n from events where user_id is not null group by 1)",
    "q_interactions": "select event_type, count(*) as n, count(distinct user_id) as n_users, round(sum(value), 4) as total from events group by 1",
    "q_sessions_recent": "select user_id, max(ts) as last_active, count(*) as n from events group by 1 order by last_active desc, user_id limit 100",
    "q_session_history": "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type = 'error' order by ts desc, event_id desc) as n from events) where event_type = 'error' or n <= 4",
    "q_running_budget": "select event_id, u as used, u <= 20 as allowed from (select event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as u from events)",
    "q_last_status": "select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "q_debounce": """
        with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 minute then 0 else 1 end as b from events),
        s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select user_id, min(ts) as started, count(*) as n_events from s group by user_id, k""",
    "q_symbol_upsert": """
        with n as (select * exclude (nth) from (select *, row_number() over (partition by symbol_id order by commit_sha desc, start_line desc nulls last, end_line desc nulls last) as nth from symbols where commit_sha is not null) where nth = 1)
        select symbol_id, repo_id, file_path, start_line from symbols s where commit_sha is null and not exists (select 1 from n where n.repo_id = s.repo_id and n.file_path = s.file_path)
        union all select symbol_id, repo_id, file_path, start_line from n""",
    "q_sparse_update": f"with {_JOBS}, {_LAST_JOB} select m.repo_id, coalesce(l.branch, m.branch) as branch, coalesce(l.org, m.org) as org, coalesce(l.repo_url, m.repo_url) as repo_url from repository_manifests m left join lj l using (repo_id)",
    "q_file_purge": "select row_id, repo_id, file_path from code_chunks c where not exists (select 1 from ast_results a where a.success = false and a.repo_id = c.repo_id and a.file_path = c.file_path)",
    "q_null_audit": " union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) filter ({c} is null) as n_null, count(*) filter ({c}::varchar = '') as n_empty from code_chunks" for c in ("chunk_text", "symbol_name", "language", "docstring", "embedding_version")),
    "q_vector_widths": "select coalesce(len(embedding), -1)::integer as width, count(*) as n from code_chunks group by 1",
    "q_snapshot_diff": f"""
        select coalesce(a.repo_id, b.repo_id) as repo_id, coalesce(a.file_path, b.file_path) as file_path, case when a.h is null then 'added' when b.h is null then 'deleted' else 'modified' end as change, a.h as old_hash, b.h as new_hash
        from {_V.format(1)} a full join {_V.format(2)} b on a.repo_id = b.repo_id and a.file_path = b.file_path where a.h is distinct from b.h""",
    "q_hash_antijoin": "select row_id from code_chunks c where embedding_version = 2 and not exists (select 1 from code_chunks o where o.embedding_version = 1 and o.repo_id = c.repo_id and o.chunk_hash = c.chunk_hash)",
    "q_touched": """
        select coalesce(o.repo_id, n.repo_id) as repo_id, case when o.repo_id is null then 'new' when n.repo_id is null then 'deleted' when n.a > o.last_indexed_at then 'changed' else 'unchanged' end as state
        from repository_manifests o full join (select repo_id, max(scanned_at) as a from source_files group by 1) n on o.repo_id = n.repo_id""",
}
