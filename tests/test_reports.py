from __future__ import annotations

import pytest

from codeloom.operators import reports


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    edges = spark.createDataFrame([(1, 2, "AMBIGUOUS", None), (2, 3, "INFERRED", 0.7), (2, 4, "INFERRED", None), (4, 5, "EXTRACTED", None)], "u int, v int, confidence string, score double")
    nodes = spark.createDataFrame([(i, f"n{i}", f"f{i % 2}.py") for i in range(1, 7)], "node int, label string, source string")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "c")], "node int, community string")
    return edges, nodes, labels


def test_reports(small):
    edges, nodes, labels = small
    assert got(reports.confidence(edges)) == [(4, 25.0, 50.0, 25.0, 0.6)]
    assert got(reports.confidence(edges.limit(0)))[0][0] == 0
    assert got(reports.representatives(edges, labels)) == [("a", "b", 2, 4, "INFERRED")]
    assert got(reports.gaps(edges, labels)) == [(4, 2)]
    assert got(reports.sources_of(nodes, labels)) == [("a", "f0.py,f1.py"), ("b", "f0.py,f1.py"), ("c", "f0.py")]
    assert [r["kind"] for r in reports.questions(edges, nodes, labels).collect()] == ["ambiguous_edge", "verify_inferred", "isolated"]


def test_violations(spark):
    nodes = spark.createDataFrame([("a", "A", "code"), ("a", "B", "code"), ("b", None, "odd")], "id string, label string, kind string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "u string, v string")
    assert got(reports.violations(nodes, edges, ["code"])) == [("dangling end", "z"), ("incomplete node", "b"), ("repeated id", "a"), ("unknown kind", "b")]


def test_distinct_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "id int, name string")
    assert got(reports.distinct_names(df, "name", ["id"]).select("id", "unique_name")) == [(1, "x"), (2, "x_1"), (3, "y"), (4, "x_2")]


def test_exports_and_lookups(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import repair, text
    from codeloom.operators import chunking, graph, metadata

    nodes, edges = spark.createDataFrame([("a<", 3), ("b", None)], "id string, community int"), spark.createDataFrame([("a<", "b")], "u string, v string")
    assert got(graph.graphml(nodes, edges)) == [('<edge source="a&lt;" target="b"/>',), ('<node id="a&lt;"><data key="community">3</data></node>',), ('<node id="b"><data key="community">-1</data></node>',)]
    s = spark.createDataFrame([("r", "f.py", "Store", "class"), ("r", "f.py", "store_it", "function"), ("r", "g.py", None, None)], "repo_id string, file_path string, symbol_name string, symbol_type string")
    assert got(graph.lookup(s, "classes", "STORE").select("symbol_name")) == [("Store",)] and got(graph.lookup(s, "symbol", "store").select("symbol_name")) == [("Store",), ("store_it",)]
    assert graph.lookup(s, "files", "g").count() == 1 and graph.lookup(s, "other", "store").isEmpty()
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3), ("y", 3)], "k string, v int")
    assert got(metadata.first_source([a, b], "k")) == [("x", 1), ("y", 3)] and got(metadata.first_source([a, b], "k", 1)) == [("x", 1)]
    names = spark.createDataFrame([('["a", "b"]',), ('[{"name": "c"}]',), ("no",), (None,)], "t string").select(metadata.json_names(F.col("t")))
    assert [r[0] for r in names.collect()] == [["a", "b"], ["c"], [], []]
    chunks = spark.createDataFrame([("r", "f", 3, 4, "c\nd"), ("r", "f", 1, 2, "a\nb"), ("r", "f", 1, 2, "a\nb"), ("r", "f", 9, 9, None)], "repo_id string, file_path string, start_line int, end_line int, chunk_text string")
    assert got(chunking.joined(chunks).select("text")) == [("a\nb\nc\nd",)]
    urls = spark.createDataFrame([("https://g/x.git",), ("https://g/x/",)], "u string").select(text.companion_url(F.col("u")))
    assert [r[0] for r in urls.collect()] == ["https://g/x-CD.git", "https://g/x-CD"]
    said = 'I call {"name": "grep", "arguments": {"q": "x"}} and [{"function": {"name": "read", "arguments": "{}"}}, {"tool": "ls", "input": []}] {broken'
    calls = spark.createDataFrame([(said,), (None,)], "t string").select(repair.tool_calls("t").alias("c")).collect()
    assert [(c["name"], c["arguments"]) for c in calls[0]["c"]] == [("grep", '{"q": "x"}'), ("read", "{}"), ("ls", "[]")] and calls[1]["c"] == []
