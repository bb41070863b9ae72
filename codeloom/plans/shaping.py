"""Queries over the operators that shape rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import communities, reports, shaping
from codeloom.operators.graph import degrees
from codeloom.plans.graph import _A, _attributed, _brands
from codeloom.storage import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files, classes, functions and methods of symbols as nodes with their degree in the containment of files and classes."""
    s = table(spark, d, "symbols").where("symbol_name is not null and symbol_id is not null").select("repo_id", "file_path", "symbol_id", "symbol_name", F.lower("symbol_type").alias("kind"), "parent_symbol_id").distinct()
    file = F.concat_ws(":", "repo_id", "file_path")
    node = F.concat_ws(":", "repo_id", "file_path", "symbol_id")
    label = F.when(F.col("parent_symbol_id").isNotNull(), F.concat(F.lit("."), "symbol_name", F.lit("()"))).when(F.col("kind") == "function", F.concat("symbol_name", F.lit("()"))).otherwise(F.col("symbol_name"))
    edges = s.select(F.when(F.col("parent_symbol_id").isNotNull(), F.concat_ws(":", "repo_id", "file_path", "parent_symbol_id")).otherwise(file).alias("u"), node.alias("v")).where("u <> v").distinct()
    named = s.groupBy(node.alias("node")).agg(F.min(label).alias("label"), F.min("file_path").alias("source"))
    files = s.groupBy(file.alias("node")).agg(F.min(F.element_at(F.split("file_path", "/"), -1)).alias("label"), F.min("file_path").alias("source"))
    return named.unionByName(files).join(degrees(edges).select("node", "degree"), "node")


def q_god_symbols(spark: SparkSession, d: str) -> DataFrame:
    return shaping.god_nodes(_nodes(spark, d), 20)


def q_node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes are hubs or stubs, and how many are concepts: for these, the parts of the catalogue by their types."""
    hubs = _nodes(spark, d).select(shaping.hub(F.col("label"), F.col("source"), F.col("degree")).alias("hub"), shaping.concept(F.col("source")).alias("concept"))
    parts = table(spark, d, "part").select(F.lit(False).alias("hub"), shaping.concept(F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_name"), F.lit(".py"))).otherwise(F.col("p_type"))).alias("concept"))
    return hubs.unionByName(parts).groupBy("hub", "concept").agg(F.count(F.lit(1)).alias("n"))


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = _attributed(spark, d)
    return reports.confidence(e.withColumn("score", F.when(F.col("u") % 3 != 0, (F.col("v") % 10) / 10.0)))


def q_dominant_confidence(spark: SparkSession, d: str) -> DataFrame:
    return shaping.dominant(_attributed(spark, d), "confidence", ["u", "v"], "EXTRACTED")


def q_community_order(spark: SparkSession, d: str) -> DataFrame:
    return shaping.ordered_communities(_brands(spark, d)).select("community_no", "community", "n_nodes")


def q_bridges(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes that reach most other communities, of equals those of the greatest degree."""
    e = _attributed(spark, d)
    reach = communities.reach(e, _brands(spark, d)).join(degrees(e).select("node", "degree"), "node")
    return reach.orderBy(F.desc("reach"), F.desc("degree"), "node").limit(5).select("node", "reach", "degree")


def q_without(spark: SparkSession, d: str) -> DataFrame:
    """Files of repositories that no job names; jobs without a repository say nothing."""
    f = table(spark, d, "source_files").select("repo_id", "file_path").distinct()
    return shaping.without(f, "repo_id", table(spark, d, "jobs").where("status <> 'completed'").select("repo_id"))


def q_test_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("repo_id", "file_path").distinct()
    return f.groupBy(shaping.top_directory(F.col("file_path")).alias("top")).agg(F.count(F.lit(1)).alias("n"), F.count_if(shaping.test_file(F.col("file_path"))).alias("n_tests"))


def q_checkouts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("repo_path")
    return table(spark, d, "repository_manifests").where("repo_path is not null").select("id", shaping.checkout_name(p).alias("name"), shaping.checkout_branch(p).alias("branch"), shaping.below_repository(F.concat(p, F.lit("/src/a.py")), "/data/repos").alias("path"))


def q_filled(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with the address and organisation of their repository's manifest where their own are missing."""
    j = table(spark, d, "jobs").select("id", "repo_id", "repo_url", "org").distinct()
    return shaping.filled(j, table(spark, d, "repository_manifests"), "repo_id", ["repo_url", "org"]).select("id", "repo_id", "repo_url", "org")


def q_known_names(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of languages that are, but for case, those of a repository."""
    f = table(spark, d, "source_files").select("language").distinct()
    return shaping.known_names(f.where("language is not null"), "language", table(spark, d, "repository_manifests").where("language is not null").select("language"))


def q_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in the order of what their nation's customers owe, in place of their own balance."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("score"), "s_nationkey")
    owed = table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    scores = s.join(owed, s["s_nationkey"] == owed["c_nationkey"]).select("key", F.col("n").alias("score"))
    return shaping.reranked(s, scores, "key", "score").select("key", "score", "rank")


def q_contained_names(spark: SparkSession, d: str) -> DataFrame:
    """For each nation the first region or nation, by name, that holds its name or that its name holds."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("key"), F.col("r_name").alias("name"))
    shorter = n.select((F.col("key") + 200).alias("key"), F.substring("name", 1, 4).alias("name"))
    return shaping.contained_names(n, r.unionByName(shorter), "key", "name")


def q_overflow(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").where("chunk_text is not null").select("repo_id", "file_path", "row_id", F.length("chunk_text").alias("n"))
    run = c.withColumn("running", F.sum("n").over(Window.partitionBy("repo_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)))
    return shaping.overflow(run, "running", 20_000, "file_path").select("n", "n_files", "summary")


def q_trimmed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")
    return shaping.trimmed(t, ["source"], "text", 5_000).select("doc_id", F.length("text").alias("n"))


def q_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all documents against those of the documents that a term finds, for each of three terms."""
    t = table(spark, d, "documents").where("text is not null")
    words = t.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).alias("words"))
    per = t.select(F.explode(F.array(*[F.when(F.contains(F.lower("text"), F.lit(w)), w) for w in ("session", "snapshot", "window")])).alias("term"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens")).where("term is not null").groupBy("term").agg(F.sum("tokens").alias("tokens"))
    return shaping.reduction(per, words.first()["words"])


def q_top_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The five commonest kinds of documents, with their sources."""
    k = table(spark, d, "documents").where("doc_kind is not null").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))
    return k.orderBy(F.desc("n"), "doc_kind").limit(5)


QUERIES = {
    f.__name__: f
    for f in (
        q_god_symbols, q_node_kinds, q_confidence, q_dominant_confidence, q_community_order, q_bridges, q_without, q_test_files, q_checkouts, q_filled, q_known_names, q_reranked, q_contained_names, q_overflow,
        q_trimmed, q_reduction, q_top_kinds,
    )
}

_NODES = """t as (select distinct repo_id, file_path, symbol_id, symbol_name, lower(symbol_type) as kind, parent_symbol_id from symbols where symbol_name is not null and symbol_id is not null),
    g as (select distinct case when parent_symbol_id is not null then concat_ws(':', repo_id, file_path, parent_symbol_id) else concat_ws(':', repo_id, file_path) end as u, concat_ws(':', repo_id, file_path, symbol_id) as v from t),
    e as (select * from g where u <> v), deg as (select node, count(*) as degree from (select u as node from e union all select v from e) group by 1),
    nm as (select concat_ws(':', repo_id, file_path, symbol_id) as node, min(case when parent_symbol_id is not null then '.' || symbol_name || '()' when kind = 'function' then symbol_name || '()' else symbol_name end) as label, min(file_path) as source from t group by 1
        union all select concat_ws(':', repo_id, file_path), min(string_split(file_path, '/')[-1]), min(file_path) from t group by 1),
    n as (select node, label, source, degree, (label <> '' and ((source <> '' and label = string_split(source, '/')[-1]) or (label like '.%' and label like '%()') or (label like '%()' and degree <= 1))) as hub,
        (source = '' or not contains(string_split(source, '/')[-1], '.')) as concept from nm join deg using (node))"""
_TESTS = r"(^|/)tests?/|/test_[^/]+$|/_test\.py$|/conftest\.py$|/testing/|\.test\.(js|ts|jsx|tsx)$|\.spec\.(js|ts|jsx|tsx)$|__tests__/"
ORACLE = {
    "q_god_symbols": f"with {_NODES} select node, label, degree from n where not hub and not concept order by degree desc, node limit 20",
    "q_node_kinds": f"""with {_NODES}, c as (select hub, concept from n union all select false, not contains(string_split(case when p_size % 2 = 0 then lower(p_name) || '.py' else p_type end, '/')[-1], '.') from part) select hub, concept, count(*) as n from c group by 1, 2""",
    "q_confidence": f"""with {_A} select count(*) as n_edges, round(100.0::double * count(*) filter (confidence = 'EXTRACTED') / count(*), 2) as extracted, round(100.0::double * count(*) filter (confidence = 'INFERRED') / count(*), 2) as inferred,
        round(100.0::double * count(*) filter (confidence = 'AMBIGUOUS') / count(*), 2) as ambiguous, round(avg(coalesce(case when u % 3 <> 0 then (v % 10) / 10.0::double end, 0.5)) filter (confidence = 'INFERRED'), 2) as mean_inferred from a""",
    "q_dominant_confidence": f"""with {_A}, b as (select u as node, confidence, u, v from a union all select v, confidence, u, v from a), k as (select node, confidence, count(*) as n, min(struct_pack(u := u, v := v)) as first from b group by 1, 2)
        select node, confidence from (select *, row_number() over (partition by node order by n desc, first) as nth from k) where nth = 1""",
    "q_community_order": "select (row_number() over (order by n_nodes desc, first) - 1)::integer as community_no, community, n_nodes from (select p_brand as community, count(*) as n_nodes, min(p_partkey) as first from part group by 1)",
    "q_bridges": f"""with {_A}, b as (select u, v from a union select v, u from a), r as (select x.u as node, count(distinct q.p_brand) as reach from b x join part p on p.p_partkey = u join part q on q.p_partkey = v where p.p_brand <> q.p_brand group by 1),
        deg as (select node, count(*) as degree from (select u as node from a union all select v from a) group by 1) select node, reach, degree from r join deg using (node) order by reach desc, degree desc, node limit 5""",
    "q_without": "select distinct repo_id, file_path from source_files f where not exists (select 1 from jobs j where j.status <> 'completed' and j.repo_id = f.repo_id)",
    "q_test_files": f"select string_split(file_path, '/')[1] as top, count(*) as n, count(*) filter (regexp_matches(lower(file_path), '{_TESTS}')) as n_tests from (select distinct repo_id, file_path from source_files) group by 1",
    "q_checkouts": """select id, case when len(p) < 2 or p[-2] = 'repos' then p[-1] else p[-2] end as name, p[-1] as branch, regexp_replace(repo_path || '/src/a.py', '^/data/repos/[^/]+/[^/]+/', '') as path
        from (select id, repo_path, string_split(repo_path, '/') as p from repository_manifests where repo_path is not null)""",
    "q_filled": "select distinct j.id, j.repo_id, coalesce(nullif(j.repo_url, ''), m.repo_url, j.repo_url) as repo_url, coalesce(nullif(j.org, ''), m.org, j.org) as org from jobs j left join repository_manifests m on m.repo_id = j.repo_id",
    "q_known_names": "select distinct language from source_files where language is not null and lower(trim(language)) in (select lower(trim(language)) from repository_manifests where language is not null)",
    "q_reranked": """with o as (select c_nationkey, count(*) as n from customer where c_acctbal < 0 group by 1), s as (select s_suppkey as key, n as score from supplier join o on c_nationkey = s_nationkey)
        select key, score, row_number() over (order by score desc, key)::integer as rank from s""",
    "q_contained_names": """with n as (select n_nationkey as key, lower(n_name) as name from nation), r as (select r_regionkey + 100 as other, r_name as name from region union all select n_nationkey + 200, substring(n_name, 1, 4) from nation)
        select n.key, arg_min(r.other, struct_pack(a := r.name, b := r.other)) as other from n join r on contains(replace(replace(n.name, '_', ''), '-', ''), replace(replace(lower(r.name), '_', ''), '-', '')) or contains(replace(replace(lower(r.name), '_', ''), '-', ''), replace(replace(n.name, '_', ''), '-', '')) group by 1""",
    "q_overflow": """with c as (select file_path, sum(length(chunk_text)) over (partition by repo_id order by row_id rows unbounded preceding) as running from code_chunks where chunk_text is not null), o as (select count(*) as n, count(distinct coalesce(file_path, '')) as n_files from c where running > 20000)
        select n, n_files, case when n > 0 then chr(10) || '[' || n || ' additional chunks from ' || n_files || ' files were not included due to context limits]' else '' end as summary from o""",
    "q_trimmed": "with t as (select doc_id, length(text) as n, sum(length(text)) over (partition by source) as total from documents where text is not null) select doc_id, (case when total > 5000 then floor(n * 5000.0::double / total) else n end)::integer as n from t",
    "q_reduction": r"""with t as (select text, greatest(1, length(text) // 4) as k from documents where text is not null), w as (select sum(len(regexp_extract_all(text, '\S+'))) as words from t),
        p as (select term, sum(k) as tokens from t, (values ('session'), ('snapshot'), ('window')) v(term) where contains(lower(text), term) group by 1), a as (select (sum(tokens) // count(*))::bigint as avg_query_tokens from p where tokens > 0)
        select avg_query_tokens, (words * 100 // 75)::bigint as corpus_tokens, round((words * 100 // 75)::double / avg_query_tokens, 1) as ratio from a, w""",
    "q_top_kinds": "select doc_kind, count(*) as n, count(distinct source) as n_sources from documents where doc_kind is not null group by 1 order by n desc, doc_kind limit 5",
}
