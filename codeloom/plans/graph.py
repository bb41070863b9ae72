"""Queries over graphs: parts that follow one another in an order (edges u, v), and the code's own symbols and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators import communities, graph, reports, traversal
from codeloom.storage import table, written

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Each row of an order with the part of the next row."""
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return li.select(F.col("l_partkey").alias("u"), F.lead("l_partkey").over(w).alias("v"), "l_orderkey", "l_returnflag", "l_linestatus", *_ORDER)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(_steps(spark, d), "u", "v")


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the attributes of their last row."""
    s = _steps(spark, d).where("v is not null and u <> v")
    confidence = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("AMBIGUOUS")
    rows = s.select("u", "v", confidence.alias("confidence"), F.when(F.col("l_linestatus") == "O", "calls").otherwise("uses").alias("relation"), "l_orderkey", *_ORDER)
    return graph.last_per_pair(rows, ["l_orderkey", *_ORDER]).select("u", "v", "confidence", "relation")


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))


def _first(edges: DataFrame, n: int = 1) -> DataFrame:
    """The n nodes of the greatest out-degree, the least of equals."""
    return graph.degrees(edges).orderBy(F.desc("out_degree"), "node").limit(n).select("node")


def q_callers(spark: SparkSession, d: str) -> DataFrame:
    e, p = _edges(spark, d), table(spark, d, "part")
    return graph.neighbours(e, p, "p_partkey", "p_name", reverse=True).groupBy("name", "other_name").agg(F.count(F.lit(1)).alias("n"))


def q_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


def q_god_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = graph.degrees(_edges(spark, d)).join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_name"), "node")
    return g.where("degree > 1").orderBy(F.desc("degree"), "node").limit(10).select("node", "p_name", "degree")


def q_node_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("node"), graph.score_nodes(p, ["widget", "steel", "brand#1", "of"], "p_name", "p_brand").alias("score")).where("score > 0")


def q_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = written(_edges(spark, d))
    return traversal.bfs(e, _first(e), 3).select("node", "depth")


def q_impact(spark: SparkSession, d: str) -> DataFrame:
    a = written(_attributed(spark, d))
    calls, imports = a.where("relation = 'calls'"), a.where("relation = 'uses'")
    return traversal.impact(calls.select("u", "v"), imports.select("u", "v"), _first(a), 2)


def q_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From the node of the greatest out-degree to the greatest node that it reaches within four steps."""
    e = written(_edges(spark, d))
    source = written(_first(e))
    target = traversal.bfs(e, source, 4).where("depth > 0").orderBy(F.desc("depth"), F.desc("node")).limit(1).select("node")
    return traversal.shortest_path(e, source, target, 4)


def q_bfs_starts(spark: SparkSession, d: str) -> DataFrame:
    """As the survey has it: from the three nodes of the greatest out-degree."""
    e = written(_edges(spark, d))
    return traversal.bfs(e, _first(e, 3), 3).select("node", "depth")


def q_impact_radius(spark: SparkSession, d: str) -> DataFrame:
    """As the survey has it: callers up to three steps away."""
    a = written(_attributed(spark, d))
    calls, imports = a.where("relation = 'calls'"), a.where("relation = 'uses'")
    return traversal.impact(calls.select("u", "v"), imports.select("u", "v"), written(_first(a)), 3)


def q_shortest_path_hops(spark: SparkSession, d: str) -> DataFrame:
    """As the survey has it: eight hops, to the greatest node among the farthest within them."""
    e = written(_edges(spark, d))
    source = written(_first(e))
    target = written(traversal.bfs(e, source, 8).where("depth > 0").orderBy(F.desc("depth"), F.desc("node")).limit(1).select("node"))
    return traversal.shortest_path(e, source, target, 8)


def q_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    a = _attributed(spark, d)
    n = F.sum("n").over(Window.partitionBy())
    return a.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(100.0 * F.col("n") / n, 2))


def q_graph_diff(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    return graph.diff(graph.edges_of(s.where("l_returnflag <> 'N'"), "u", "v"), graph.edges_of(s.where("l_returnflag <> 'R'"), "u", "v"))


def q_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return communities.cohesion(_edges(spark, d), _brands(spark, d))


def q_inter_community(spark: SparkSession, d: str) -> DataFrame:
    return communities.between(_edges(spark, d), _brands(spark, d))


def q_community_reach(spark: SparkSession, d: str) -> DataFrame:
    return communities.reach(_edges(spark, d), _brands(spark, d))


def q_surprise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 3).alias("kind"), F.col("p_type").alias("top_dir"), F.col("p_brand").alias("community"), F.concat_ws("/", "p_type", "p_name").alias("source"))
    return communities.surprise(_attributed(spark, d), nodes)


def q_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.calls(table(spark, d, "source_files").select("repo_id", "file_path", "content"), table(spark, d, "symbols"))


def q_containment(spark: SparkSession, d: str) -> DataFrame:
    return graph.containment(table(spark, d, "symbols"))


def q_file_context(spark: SparkSession, d: str) -> DataFrame:
    """The classes of a file with the number of their methods, and its functions."""
    s = table(spark, d, "symbols").where("symbol_name is not null").select("repo_id", "file_path", "symbol_id", "symbol_type", "symbol_name", "parent_symbol_id").distinct()
    return s.groupBy("repo_id", "file_path").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("symbol_type") == "class", F.col("symbol_name")))), ",").alias("classes"), F.count_if(F.col("parent_symbol_id").isNotNull()).alias("n_methods"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("symbol_type") == "function", F.col("symbol_name")))), ",").alias("functions"),
    )


def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Files that are connected by calls between them."""
    c = q_calls(spark, d).where("caller_path <> callee_path")
    key = lambda p: F.concat_ws(":", "repo_id", p)
    return communities.components(c.select(key("caller_path").alias("u"), key("callee_path").alias("v")))


def q_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return communities.label_propagation(_edges(spark, d))


def q_representatives(spark: SparkSession, d: str) -> DataFrame:
    return reports.representatives(_attributed(spark, d), _brands(spark, d))


def q_unique_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return reports.distinct_names(p, "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


def q_violations(spark: SparkSession, d: str) -> DataFrame:
    """Symbols as nodes and parents as edges: what is missing, given twice or leads nowhere."""
    s = table(spark, d, "symbols")
    nodes = s.select(F.col("symbol_id").alias("id"), F.col("signature").alias("label"), F.col("symbol_type").alias("kind"))
    edges = s.where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("u"), F.col("symbol_id").alias("v"))
    return reports.violations(nodes, edges, ["function", "class"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        q_callers, q_degrees, q_god_nodes, q_node_score, q_bfs, q_impact, q_shortest_path, q_bfs_starts, q_impact_radius, q_shortest_path_hops, q_graph_stats, q_graph_diff, q_cohesion, q_inter_community, q_community_reach, q_surprise, q_calls, q_containment,
        q_file_context, q_components, q_label_propagation, q_representatives, q_unique_names, q_violations,
    )
}

_S = f"s as (select l_partkey as u, lead(l_partkey) over (partition by l_orderkey order by {', '.join(_ORDER)}) as v, l_orderkey, l_returnflag, l_linestatus, {', '.join(_ORDER)} from lineitem)"
_G = f"{_S}, g as (select distinct u, v from s where v is not null and u <> v)"
_A = f"""{_S}, a as (select u, v, case l_returnflag when 'A' then 'EXTRACTED' when 'N' then 'INFERRED' else 'AMBIGUOUS' end as confidence, case l_linestatus when 'O' then 'calls' else 'uses' end as relation
    from (select *, row_number() over (partition by u, v order by l_orderkey desc, {', '.join(f'{c} desc' for c in _ORDER)}) as n from s where v is not null and u <> v) where n = 1)"""
_DEG = "deg as (select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree, count(*) as degree from (select u as node, 1 as o, 0 as i from {0} union all select v, 0, 1 from {0}) group by 1)"
_WALK = "f as (select node from deg order by out_degree desc, node limit 1), w as (select node, 0 as depth from f union select g.v, w.depth + 1 from w join g on g.u = w.node where w.depth < {0}), m as (select node, min(depth)::integer as depth from w group by 1)"
_CALLS = r"""mk as (select distinct repo_id, file_path as caller_path, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) as callee from source_files),
    kn as (select distinct repo_id, symbol_name as callee, file_path as callee_path from symbols where lower(symbol_type) in ('function', 'method') and symbol_name is not null)"""
_CL = "case when lower(symbol_type) in ('class', 'struct', 'interface') then {} else {} end"
ORACLE = {
    "q_callers": f"with {_G} select b.p_name as name, a.p_name as other_name, count(*) as n from g join part a on a.p_partkey = g.u join part b on b.p_partkey = g.v group by 1, 2",
    "q_degrees": f"with {_G}, {_DEG.format('g')} select * from deg",
    "q_god_nodes": f"with {_G}, {_DEG.format('g')} select node, p_name, degree from deg join part on p_partkey = node where degree > 1 order by degree desc, node limit 10",
    "q_node_score": "select * from (select p_partkey as node, " + " + ".join(f"contains(lower(p_name), '{t}')::int + 0.5::double * contains(lower(p_brand), '{t}')::int" for t in ("widget", "steel", "brand#1")) + " as score from part) where score > 0",
    "q_bfs": f"with recursive {_G}, {_DEG.format('g')}, {_WALK.format(3)} select node, depth from m",
    "q_impact": f"""
        with recursive {_A}, {_DEG.format('a')}, f as (select node from deg order by out_degree desc, node limit 1),
        w as (select node, 0 as depth from f union select a.u, w.depth + 1 from w join a on a.v = w.node and a.relation = 'calls' where w.depth < 2), m as (select node, min(depth)::integer as depth from w group by 1)
        select node, depth, case depth when 1 then 'calls' else 'transitive_call' end as relation from m where depth > 0
        union all select distinct a.u, 1, 'imports' from a join f on a.v = f.node where a.relation = 'uses' and a.u not in (select node from m where depth > 0)""",
    "q_shortest_path": f"""
        with recursive {_G}, {_DEG.format('g')}, {_WALK.format(4)},
        p as (select m.node, m.depth, min(g.u) as parent from m join g on g.v = m.node join m x on x.node = g.u and x.depth = m.depth - 1 group by 1, 2),
        t as (select node, depth from m where depth > 0 order by depth desc, node desc limit 1),
        r as (select depth as hop, node from t union all select r.hop - 1, p.parent from r join p on p.node = r.node where r.hop > 0)
        select hop::integer as hop, node from r""",
    "q_bfs_starts": f"with recursive {_G}, {_DEG.format('g')}, {_WALK.format(3).replace('limit 1', 'limit 3')} select node, depth from m",
    "q_impact_radius": f"""
        with recursive {_A}, {_DEG.format('a')}, f as (select node from deg order by out_degree desc, node limit 1),
        w as (select node, 0 as depth from f union select a.u, w.depth + 1 from w join a on a.v = w.node and a.relation = 'calls' where w.depth < 3), m as (select node, min(depth)::integer as depth from w group by 1)
        select node, depth, case depth when 1 then 'calls' else 'transitive_call' end as relation from m where depth > 0
        union all select distinct a.u, 1, 'imports' from a join f on a.v = f.node where a.relation = 'uses' and a.u not in (select node from m where depth > 0)""",
    "q_shortest_path_hops": f"""
        with recursive {_G}, {_DEG.format('g')}, {_WALK.format(8)},
        p as (select m.node, m.depth, min(g.u) as parent from m join g on g.v = m.node join m x on x.node = g.u and x.depth = m.depth - 1 group by 1, 2),
        t as (select node, depth from m where depth > 0 order by depth desc, node desc limit 1),
        r as (select depth as hop, node from t union all select r.hop - 1, p.parent from r join p on p.node = r.node where r.hop > 0)
        select hop::integer as hop, node from r""",
    "q_graph_stats": f"with {_A} select confidence, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as share from a group by 1",
    "q_graph_diff": f"""
        with {_S}, o as (select distinct u, v from s where v is not null and u <> v and l_returnflag <> 'N'), n as (select distinct u, v from s where v is not null and u <> v and l_returnflag <> 'R')
        select *, 'removed' as change from (select * from o except select * from n) union all select *, 'added' as change from (select * from n except select * from o)""",
    "q_cohesion": f"""
        with {_G}, p as (select distinct least(u, v) as u, greatest(u, v) as v from g), i as (select a.p_brand as community, count(*) as n_edges from p join part a on a.p_partkey = u join part b on b.p_partkey = v where a.p_brand = b.p_brand group by 1),
        z as (select p_brand as community, count(*) as n_nodes from part group by 1)
        select community, n_nodes, coalesce(n_edges, 0) as n_edges, case when n_nodes <= 1 then 1.0::double else round(coalesce(n_edges, 0) * 2.0::double / (n_nodes * (n_nodes - 1)), 2) end as cohesion from z left join i using (community)""",
    "q_inter_community": f"with {_G} select least(a.p_brand, b.p_brand) as a, greatest(a.p_brand, b.p_brand) as b, count(*) as n_edges from g join part a on a.p_partkey = u join part b on b.p_partkey = v where a.p_brand <> b.p_brand group by 1, 2",
    "q_community_reach": f"with {_G}, b as (select u, v from g union select v, u from g) select u as node, a.p_brand as community, count(distinct c.p_brand) as reach from b join part a on a.p_partkey = u join part c on c.p_partkey = v where a.p_brand <> c.p_brand group by 1, 2",
    "q_surprise": f"""
        with {_A}, {_DEG.format('a')}, n as (select p_partkey as node, p_size % 3 as kind, p_type as top_dir, p_brand as community, p_type || '/' || p_name as source, degree from part join deg on node = p_partkey)
        select u, v, (case confidence when 'AMBIGUOUS' then 3 when 'INFERRED' then 2 else 1 end + case when x.kind <> y.kind then 2 else 0 end + case when x.top_dir <> y.top_dir then 2 else 0 end + case when x.community <> y.community then 1 else 0 end
            + case when least(x.degree, y.degree) <= 2 and greatest(x.degree, y.degree) >= 5 then 1 else 0 end)::integer as score
        from a join n x on x.node = u join n y on y.node = v where x.source <> y.source""",
    "q_calls": f"with {_CALLS} select mk.repo_id, mk.callee, mk.caller_path, kn.callee_path from mk join kn using (repo_id, callee)",
    "q_containment": f"""
        with t as (select *, 'file:' || repo_id || ':' || file_path as f, {_CL.format("'class:'", "'func:'")} || repo_id || ':' || file_path || ':' || symbol_id as n from symbols where symbol_name is not null)
        select distinct 'repo:' || repo_id as src, f as dst, 'CONTAINS' as type from t
        union select distinct case when parent_symbol_id is not null then 'class:' || repo_id || ':' || file_path || ':' || parent_symbol_id else f end, n, case when parent_symbol_id is not null then 'HAS_METHOD' else {_CL.format("'DECLARES'", "'DECLARES_FUNC'")} end from t""",
    "q_file_context": """
        with t as (select distinct repo_id, file_path, symbol_id, symbol_type, symbol_name, parent_symbol_id from symbols where symbol_name is not null)
        select repo_id, file_path, coalesce(string_agg(distinct symbol_name, ',' order by symbol_name) filter (symbol_type = 'class'), '') as classes, count(*) filter (parent_symbol_id is not null) as n_methods,
            coalesce(string_agg(distinct symbol_name, ',' order by symbol_name) filter (symbol_type = 'function'), '') as functions from t group by 1, 2""",
    "q_representatives": f"""
        with {_A}, m as (select least(x.p_brand, y.p_brand) as a, greatest(x.p_brand, y.p_brand) as b, u, v, confidence, case confidence when 'AMBIGUOUS' then 0 when 'INFERRED' then 1 else 2 end as r from a join part x on x.p_partkey = u join part y on y.p_partkey = v where x.p_brand <> y.p_brand)
        select a, b, u, v, confidence from (select *, row_number() over (partition by a, b order by r, u, v) as n from m) where n = 1""",
    "q_unique_names": "select p_partkey, case when n = 0 then p_name else p_name || '_' || n end as unique_name from (select *, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)",
    "q_violations": """
        with p as (select 'incomplete node' as problem, symbol_id as id from symbols where symbol_id is null or signature is null union all select 'unknown kind', symbol_id from symbols where symbol_type not in ('function', 'class')
            union all select 'repeated id', symbol_id from symbols group by symbol_id having count(*) > 1
            union all select 'dangling end', id from (select distinct parent_symbol_id as id from symbols where parent_symbol_id is not null union select symbol_id from symbols where parent_symbol_id is not null) where id not in (select symbol_id from symbols where symbol_id is not null))
        select problem, count(*) as n from p group by 1""",
    "q_components": f"""
        with recursive {_CALLS}, e as (select distinct mk.repo_id || ':' || caller_path as u, mk.repo_id || ':' || callee_path as v from mk join kn using (repo_id, callee) where caller_path <> callee_path),
        b as (select u, v from e union select v, u from e), w as (select u as node, u as r from b union select b.v, w.r from w join b on b.u = w.node)
        select node, min(r) as component from w group by 1""",
}
