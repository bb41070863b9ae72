"""Operators on small fixtures, against values worked out by hand or by plain programs."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import storage
from codeloom.functions import repair, text
from codeloom.operators import chunking, communities, filters, graph, metadata, snapshots, traversal, vectors
from codeloom.plans import graph as plans
from codeloom.streaming import feeds


def got(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------ files and snapshots


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3"), ("r", "d", "9")], "repo string, path string, content_hash string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "5"), ("r", "x", "3"), ("r", "e", "7")], old.schema)
    c = snapshots.changes(old, new, ["repo", "path"])
    assert got(c.select("path", "change")) == [("b", "modified"), ("c", "deleted"), ("d", "deleted"), ("e", "added"), ("x", "added")]
    r = snapshots.renames(c, "repo", "path")
    assert got(r.select("path", "change", F.coalesce("old_path", F.lit("")))) == [("b", "modified", ""), ("d", "deleted", ""), ("e", "added", ""), ("x", "renamed", "c")]
    assert snapshots.changes(old, old, ["repo", "path"]).isEmpty()
    assert got(snapshots.changes(old.limit(0), new, ["repo", "path"]).select("change").distinct()) == [("added",)]


def test_changed_lines(spark):
    s = "k string, t string"
    a, b = spark.createDataFrame([("f", "1\n2\n3\n4")], s), spark.createDataFrame([("f", "1\nx\ny\n4\n5")], s)
    assert got(snapshots.changed_lines(a, b, ["k"], "t")) == [("f", 2, 3), ("f", 5, 5)]


def test_admission(spark):
    rows = [("a/test.pyc", 1), ("image.png", 1), ("doc.pdf", 1), ("x.py", 1), ("node_modules/x.py", 1), (".github/w.yml", 1), (".git/x.py", 1), ("big.py", 2_000_000), ("Makefile", 1), ("my.api.py", 1), ("app.login.ts", 1)]
    df = spark.createDataFrame(rows, "p string, n long")
    ok = df.where(filters.admitted(F.col("p"), F.col("n")) & filters.admitted_dirs(F.col("p"))).select("p")
    # ignored parts are looked for anywhere in the name: .a is in my.api.py, .log in app.login.ts
    assert got(ok) == [(".github/w.yml",), ("Makefile",), ("x.py",)]


@pytest.mark.parametrize("path, hit", [("vendor/lib.py", True), ("a/vendor/b.py", True), ("a/vendored.py", False), ("x/y.log", True), ("docs/a/b.md", True), ("doc/a.md", False)])
def test_ignored(spark, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(filters.ignored(F.col("p"), ["vendor/", "*.log", "/docs"])).first()[0] is hit


def test_sensitive(spark):
    df = spark.createDataFrame([(".env",), ("a/id_rsa",), ("k.pem",), ("my_secret.py",), ("main.py",)], "p string")
    assert [r[0] for r in df.select(filters.sensitive(F.col("p"))).collect()] == [True, True, True, True, False]


def test_structure_modes(spark):
    s = spark.createDataFrame([("r", "a.py", "Broker", "class"), ("r", "a.py", "load", "function"), ("r", "b.ts", None, "function"), ("r", "tests/c.py", "load", "function")], "repo_id string, file_path string, symbol_name string, symbol_type string")
    assert got(filters.structure(s, suffixes=(".ts",), classes=("brok",)).select("file_path")) == [("a.py",), ("b.ts",)]
    assert got(filters.structure(s, suffixes=(".py",), functions=("LOAD",), exclude=("tests/",), mode="documented").select("file_path")) == [("a.py",)]


# ------------------------------------------------------------------ stores


def test_upsert_and_sparse_update(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(2, "c", 3, 1), (2, "d", 4, 2), (3, "e", 5, 1), (None, "z", 0, 9)], "id int, x string, y int, n int")
    assert got(storage.upsert(old, new, ["id"], "n")) == [(1, "a", 1), (2, "d", 4), (3, "e", 5)]
    patch = spark.createDataFrame([(1, None, 7)], "id int, x string, y int")
    assert got(storage.sparse_update(old, patch, ["id"])) == [(1, "a", 7), (2, "b", 2)]


def test_replace_and_delete_files(spark):
    s = "repo_id string, file_path string, v int"
    old = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 3), ("q", "a", 4)], s)
    new = spark.createDataFrame([("r", "a", 9)], s)
    assert got(storage.replace_files(old, new)) == [("q", "a", 4), ("r", "a", 9), ("r", "b", 3)]
    assert got(storage.delete_files(old, new)) == [("q", "a", 4), ("r", "b", 3)]


def test_evolve(spark):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    out = storage.evolve(df, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType())]), {"b": 5})
    assert out.dtypes == [("a", "bigint"), ("b", "int"), ("extra", "string")] and got(out) == [(1, 5, "x")]


def test_append_chunks(spark, tmp_path):
    df = spark.createDataFrame([("r", "t")], "repo_id string, chunk_text string")
    for _ in range(2):
        storage.append_chunks(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2


# ------------------------------------------------------------------ vectors


def test_best_score_of_each_repository(spark):
    hits = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.6), (1, "a", 0.9), (1, "c", 0.4)], "q int, repo string, score double")
    best = vectors.best_per_key(hits, "repo", "score", ["q"]).orderBy(F.desc("score")).limit(2)
    assert [(r["repo"], r["score"]) for r in best.collect()] == [("a", 0.9), ("b", 0.6)]


def test_top_k_with_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [2.0, 0.1])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    out = vectors.top_k(df, [1.0, 0.0], 3, "id", min_score=0.5)
    assert [r["id"] for r in out.collect()] == [1, 5]  # the threshold comes after the limit
    assert vectors.top_k(df.limit(0), [1.0, 0.0], 3, "id").isEmpty()


def test_first_query_keeps_its_score(spark):
    df = spark.createDataFrame([(1, [1.0, 0.2]), (2, [0.0, 1.0])], "id int, embedding array<float>")
    out = vectors.multi_query(df, [[0.0, 1.0], [1.0, 0.0]], 2, "id", ["id"], min_score=-1)
    assert {(r["id"], r["q_idx"]) for r in out.collect()} == {(1, 0), (2, 0)}


def test_files_by_suffix(spark):
    hits = spark.createDataFrame([("/srv/r/src/a.py", 1), ("/srv/r/xsrc/a.py", 2), ("src/a.py", 3)], "file_path string, n int")
    files = spark.createDataFrame([("src/a.py",)], "file_path string")
    assert got(vectors.in_files(hits, files).select("n")) == [(1,), (3,)]


def test_embedding_stand_in(spark):
    df = spark.createDataFrame([("same words here",), ("here same words",), ("other",), ("",), (None,)], "t string")
    e = [r[0] for r in df.select(vectors.embed(F.col("t"), 16)).collect()]
    assert e[0] == e[1] != e[2] and sum(x * x for x in e[0]) == pytest.approx(1) and set(e[3]) == set(e[4]) == {0.0}


# ------------------------------------------------------------------ texts


@pytest.mark.parametrize(
    "given, expected",
    [
        ("postgres://u:pass1@h", "postgres://u:<CONNECTION_PASSWORD>@h"),
        ("mail a.b+c@d.example.org now", "mail <EMAIL_ADDRESS> now"),
        ("+1 (743) 555-3824", "+1 (<PHONE_NUMBER>"),
        ("host 10.0.0.12:80", "host <IP_ADDRESS>:80"),
        ("é123-45-6789", "é123-45-6789"),
        ("n 123-45-6789", "n <SSN>"),
        ("ghp_" + "a1" * 18, "<GITHUB_TOKEN>"),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "<PRIVATE_KEY>"),
        ("api_key = 'abcdefghijklmnop1'", "api_key = '<API_KEY>'"),
        ("Authorization: Bearer abc.def", "Authorization: Bearer <BEARER_TOKEN>"),
        ("password: hunter22", "<PASSWORD_FIELD>"),
        ("nothing here", "nothing here"),
        ("", ""),
        (None, None),
    ],
)
def test_redact(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == expected


def test_identities(spark):
    df = spark.createDataFrame([("r", "f.py", "class", "C", "body")], "r string, p string, k string, n string, t string")
    row = df.select(text.short_hash(F.col("t")), text.chunk_id(F.col("r"), F.col("t")), text.symbol_id(*[F.col(c) for c in "rpkn"]), text.graph_id(F.col("r"), F.col("p"), "func", F.col("n"), F.lit("m")), text.node_id(F.lit("_a."), F.lit("B c!"))).first()
    h = hashlib.sha256(b"body").hexdigest()[:16]
    assert tuple(row) == (h, f"r_{h}", hashlib.sha256(b"r:f.py:class:C").hexdigest()[:20], "func:r:f.py:C.m", "a_b_c")


def test_urls_and_html(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/1?x=1",), ("http://h/a.PDF?x",), ("https://h/i.png",), ("http://169.254.169.254/x",), ("ftp://h/",)], "u string")
    kinds = [tuple(r) for r in df.select(text.url_type(F.col("u")), text.allowed_url(F.col("u")), text.file_name(F.col("u"))).collect()]
    assert kinds == [("arxiv", True, "arxiv_org_abs_1"), ("pdf", True, "h_a_PDF"), ("image", True, "h_i_png"), ("webpage", False, "169_254_169_254_x"), ("webpage", False, "h")]
    page = "<html><title> A\n B </title><script>x<y</script><p>one<br>two</p></html>"
    h = spark.createDataFrame([(page,)], "h string").select(text.html_text(F.col("h")), text.html_title(F.col("h"), F.lit("d"))).first()
    assert tuple(h) == ("A B one two", "A B")


def test_markdown(spark):
    md = "---\nname: x\n---\n# T\n## When to use\n- one\n- two\n\n## Next\n```py\ncode()\n```\n"
    df = spark.createDataFrame([(md,)], "t string")
    c = F.col("t")
    row = df.select(text.front_matter(c), text.section(c, "When to use"), text.bullets(text.section(c, "When to use")), text.code_blocks(c), text.without_front_matter(c)).first()
    assert row[0] == "name: x" and row[1] == "- one\n- two" and row[2] == ["one", "two"] and row[3] == ["code()\n"] and row[4].startswith("# T")


@pytest.mark.parametrize(
    "given, expected",
    [('{"a": 1, // note\n "b": [1, 2,],}', {"a": 1, "b": [1, 2]}), ('text {"a": {"b": "x}"', {"a": {"b": "x}"}}), ("say ```json\n{\"a\": 2}\n``` done", {"a": 2}), ('{"a": "/* no */"}', {"a": "/* no */"}), ("no object", None), ("", None), (None, None), ("{]", None)],
)
def test_structured_output(spark, given, expected):
    out = spark.createDataFrame([(given,)], "t string").select(repair.structured_output(F.col("t"))).first()[0]
    assert (None if out is None else json.loads(out)) == expected


def test_repetition_and_anonymise(spark):
    phrase = "this goes on and on. "
    df = spark.createDataFrame([("start " + phrase * 6,), ("fine",), (None,)], "t string")
    assert [r[0] for r in df.select(repair.cut_repetition(F.col("t"))).collect()] == ["start " + phrase, "fine", None]
    t = "a@b.de and c@d.de, then a@b.de from 10.1.2.3"
    row = spark.createDataFrame([(t,)], "t string").select(repair.anonymise("t").alias("x")).select("x.text", repair.restore(F.col("x.text"), F.col("x.vault"))).first()
    assert row[0] == "<EMAIL_1> and <EMAIL_2>, then <EMAIL_1> from <IP_1>" and row[1] == t


# ------------------------------------------------------------------ chunks and batches


def plain_line_chunks(content, size, overlap):
    lines, at, out = content.split("\n"), 0, []
    while at < len(lines):
        end, chars, taken = at, 0, []
        while end < len(lines) and chars < size:
            taken.append(lines[end])
            chars += len(lines[end]) + 1
            end += 1
        out.append((at + 1, end, "\n".join(taken)))
        at = end - max(1, int(overlap / size * len(taken)))
        if at <= end - len(taken):
            at = end
    return out


@pytest.mark.parametrize("content", ["one line", "a\n" * 300, "x" * 2000 + "\ny\nz", "\n".join(str(i) * (i % 90) for i in range(400)), "\n\n\n"])
def test_line_chunks(spark, content):
    df = spark.createDataFrame([(1, content), (2, ""), (3, None)], "id int, t string")
    out = chunking.line_chunks(df, ["id"], "t").orderBy("chunk_no").collect()
    assert [(r["start_line"], r["end_line"], r["chunk_text"]) for r in out] == plain_line_chunks(content, 512, 128)
    assert all(r["chunk_hash"] == hashlib.sha256(r["chunk_text"].encode()).hexdigest()[:16] and content[r["start_char"] :].startswith(r["chunk_text"]) for r in out)


def test_char_chunks(spark):
    content = "\n".join(f"line {i} " + "x" * (i % 60) for i in range(300))
    out = chunking.char_chunks(spark.createDataFrame([(1, content), (2, "short")], "id int, t string"), ["id"], "t").orderBy("chunk_no").collect()
    assert all(len(r["chunk_text"]) <= 2048 for r in out) and out[0]["start_line"] == 1 and out[-1]["end_line"] == 300
    assert all(b["start_line"] == a["end_line"] - 2 for a, b in zip(out, out[1:], strict=False))


def test_symbol_chunks(spark):
    content = "import x\n\n\ndef tiny(): pass\n\nclass LargeComponent:\n    " + "y = 1 # long enough to be kept as a chunk of its own\n    " * 2
    files = spark.createDataFrame([("r", "f.py", "python", content)], "repo_id string, file_path string, language string, content string")
    symbols = spark.createDataFrame([("r", "f.py", "tiny", "function", None, 4, 4), ("r", "f.py", "LargeComponent", "class", None, 6, 8)], "repo_id string, file_path string, symbol_name string, symbol_type string, parent_name string, start_line int, end_line int")
    out = chunking.symbol_chunks(files, symbols).collect()
    assert [(r["symbol_name"], r["start_line"], r["end_line"]) for r in out] == [("LargeComponent", 6, 8)]
    assert out[0]["chunk_text"].startswith("# File: f.py\n# Kind: class\n# Language: python\nclass LargeComponent")
    assert {r["symbol_name"] for r in chunking.symbol_chunks(files, symbols, fewest=1).collect()} == {"tiny", "LargeComponent", None}


def plain_batches(sizes, items, most, overlap):
    out, now, total = [], [], 0
    for s in sizes:
        if now and (len(now) >= items or total + s > most):
            out.append(now)
            last = now[-1]
            now, total = ([last], last) if overlap and last + s <= most else ([], 0)
        now.append(s)
        total += s
    return out + [now]


@pytest.mark.parametrize("overlap", [False, True])
def test_token_batches(spark, overlap):
    sizes = [5, 9, 30, 1, 1, 1, 8, 20, 2, 2, 2, 2, 19, 1]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)] + [("h", 0, 7)], "g string, i int, n long")
    out = chunking.token_batches(df, "g", "i", "n", 4, 20, overlap).where("g = 'g'").collect()
    got_ = [sorted(r["n"] for r in out if r["batch_no"] == b) for b in range(max(r["batch_no"] for r in out) + 1)]
    assert got_ == [sorted(b) for b in plain_batches(sizes, 4, 20, overlap)]


def test_budget(spark):
    df = spark.createDataFrame([("g", i, 200) for i in range(3)], "g string, i int, n int")
    out = chunking.within_budget(df, ["g"], ["i"], "n", 500)
    assert got(out.select("i", "taken")) == [(0, 200), (1, 200)]  # what is left, 100, is too little
    assert got(chunking.within_budget(df, ["g"], ["i"], "n", 510).select("i", "taken"))[-1] == (2, 110)
    assert chunking.within_budget(df.limit(0), ["g"], ["i"], "n", 510).isEmpty()


# ------------------------------------------------------------------ metadata


def test_histories(spark):
    df = spark.createDataFrame([(1, i, "system" if i == 0 else "user") for i in range(7)], "conv int, turn int, role string")
    assert got(metadata.history(df, "conv", ["turn"], 3, F.col("role") == "system").select("turn")) == [(0,), (4,), (5,), (6,)]
    run = metadata.running_count(df, "conv", ["turn"], 5)
    assert [r["allowed"] for r in run.orderBy("turn").collect()] == [True] * 5 + [False] * 2


def test_overlap_matches(spark):
    gaps = spark.createDataFrame([(1, "Authentication Service"), (2, "Email Notification Engine"), (3, "!!"), (4, None)], "gap int, title string")
    have = spark.createDataFrame([(10, "authentication-service v2"), (11, "Payment Gateway"), (12, "service")], "id int, name string")
    out = metadata.overlap_matches(gaps, have, "gap", "title", "id", "name", 0.3)
    assert got(out) == [(1, 10, 1.0)]


def test_overlap_against_brute_force(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["hot"] * 12
    a = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    b = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    out = metadata.overlap_matches(spark.createDataFrame(a, "i int, t string"), spark.createDataFrame(b, "j int, u string"), "i", "t", "j", "u", 0.5)
    expected = []
    for i, t in a:
        w = set(t.split())
        best = min(((-len(w & set(u.split())) / len(w), j) for j, u in b), default=None)
        if -best[0] >= 0.5:
            expected.append((i, best[1], -best[0]))
    assert got(out) == expected


def test_leaderboard(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "who string")
    assert got(metadata.leaderboard(df, "who")) == [("a", 2, 1), ("b", 1, 2), ("c", 1, 2)]


# ------------------------------------------------------------------ graphs


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (7, 3), (8, 9)], "u int, v int")


def test_walks(spark, chain):
    start = spark.createDataFrame([(1,)], "node int")
    assert got(traversal.bfs(chain, start, 3).select("node", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 3), (6, 1)]
    assert got(traversal.bfs(chain, start.limit(0), 3)) == []
    back = spark.createDataFrame([(4,)], "node int")
    imports = spark.createDataFrame([(9, 4), (3, 4)], "u int, v int")
    assert got(traversal.impact(chain, imports, back, 3)) == [(1, 3, "transitive_call"), (2, 2, "transitive_call"), (3, 1, "calls"), (7, 2, "transitive_call"), (9, 1, "imports")]
    target = spark.createDataFrame([(5,)], "node int")
    assert got(traversal.shortest_path(chain, start, target)) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert traversal.shortest_path(chain, start, target, 3).isEmpty()


def test_components_and_labels(spark, chain):
    assert got(communities.components(chain)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)]
    assert communities.components(chain.limit(0)).isEmpty()
    clique = [(a, b) for g in ((1, 2, 3, 4), (5, 6, 7, 8)) for a in g for b in g if a < b] + [(4, 5)]
    labels = communities.label_propagation(spark.createDataFrame(clique, "u int, v int"), 6)
    assert len({r["community"] for r in labels.where("node <= 4").collect()}) == 1


def _plain_labels(edges, rounds=20):
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    labels = {x: x for x in near}
    for _ in range(rounds):
        after = {x: min((-sum(labels[y] == c for y in ys), c) for c in {labels[y] for y in ys})[1] for x, ys in near.items()}
        if after == labels:
            break
        labels = after
    return {frozenset(x for x in labels if labels[x] == c) for c in labels.values()}


def test_labels_until_stable_and_split(spark):
    rng = random.Random(3)
    tree = [(rng.randrange(max(0, i - 6), i), i) for i in range(1, 60)]
    blocks = [(a, b) for g in range(0, 30, 6) for a in range(g, g + 6) for b in range(a) if b >= g or rng.random() < 0.4]
    split = 0
    for edges in (tree, blocks, [(i, i + 1) for i in range(40)], [(a, b) for a in range(12) for b in range(a)]):
        whole = _plain_labels(edges)
        most = max(10, int(sum(map(len, whole)) * 0.25))
        parts = set()
        for c in whole:
            inner = _plain_labels([e for e in edges if set(e) <= c]) if len(c) > most else {c}
            parts |= inner | {frozenset([x]) for x in c.difference(*inner)}
        split += parts != whole
        found = {}
        for r in communities.label_propagation(spark.createDataFrame(edges, "u int, v int")).collect():
            found.setdefault(r["community"], set()).add(r["node"])
        assert {frozenset(x) for x in found.values()} == parts
    assert split
    assert communities.label_propagation(spark.createDataFrame([], "u int, v int")).isEmpty()


def test_walks_at_the_parameters_of_the_survey(spark, tmp_path):
    def tables(name, edges):
        rows = [(k, p, n, 1, 1.0, 1.0, "A", "O") for k, e in enumerate(edges) for n, p in enumerate(e)]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        return f"{tmp_path}/{name}"

    back = tables("back", [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6)])
    assert got(plans.q_impact_radius(spark, back)) == [(1, 3, "transitive_call"), (2, 2, "transitive_call"), (3, 1, "calls")]
    far = tables("far", [(i, i + 1) for i in range(1, 12)] + [(1, 50), (20, 21), (20, 22), (30, 31), (30, 32)])
    assert got(plans.q_bfs_starts(spark, far).where("depth = 0")) == [(1, 0), (20, 0), (30, 0)]
    assert got(plans.q_shortest_path_hops(spark, far)) == [(i, i + 1) for i in range(9)]


def test_measures(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "u int, v int")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "node int, community string")
    assert got(communities.cohesion(e, labels)) == [("a", 3, 3, 1.0), ("b", 1, 0, 1.0)]
    assert got(communities.between(e, labels)) == [("a", "b", 1)]
    assert got(communities.reach(e, labels)) == [(3, "a", 1), (4, "b", 1)]


def test_betweenness(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u int, v int")
    everyone = spark.createDataFrame([(i,) for i in range(1, 5)], "node int")
    out = {r["node"]: r["betweenness"] / 2 for r in communities.betweenness(path, everyone).collect()}
    assert (out[2], out[3], out.get(1, 0), out.get(4, 0)) == (2.0, 2.0, 0.0, 0.0)


def test_graph_edits(spark):
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f2")], "id string, source_file string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 1)], "u string, v string, n int")
    assert got(graph.last_per_pair(edges, ["n"])) == [("a", "b", 2), ("b", "c", 1)]
    n, e = graph.remove_files(nodes, edges, spark.createDataFrame([("f1",)], "source_file string"))
    assert got(n.select("id")) == [("b",), ("c",)] and got(e) == [("b", "c", 1)]
    assert got(graph.diff(edges, edges.where("u = 'a'"))) == [("b", "c", "removed")]
    assert got(graph.cypher(nodes.limit(1), "source_file", "id")) == [("MERGE (n:f1 {id: 'a'});",)]
    assert graph.json_lines(nodes, edges).count() == 6
    assert got(graph.attach(nodes, spark.createDataFrame([("a", "z"), ("d", "q"), ("d", "p")], "id string, source_file string"))) == [("a", "f1"), ("b", "f2"), ("c", "f2"), ("d", "p")]


# ------------------------------------------------------------------ streams


def test_bursts_on_a_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(t(0), "a.py"), (t(2), "b.py"), (t(2), "a.py"), (t(60), "c.md"), (t(600), "z.py")]
    schema = "ts timestamp, path string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = feeds.bursts(stream, "ts", "3 seconds", path="path", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    spark.createDataFrame([(t(1200), "y.py")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    out = spark.table("bursts").where(F.col("started") < t(500)).withColumn("code", feeds.only_code("paths", [".py"]))
    assert got(out.select("n", F.array_join("paths", ","), "code")) == [(1, "c.md", False), (3, "a.py,b.py", True)]


def test_incremental_index(spark, tmp_path):
    schema = "repo_id string, file_path string, content string"
    chunk = lambda b: chunking.windows(b, "content", 4, 0)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for batch in ([("r", "a", "12345678"), ("r", "b", "1234")], [("r", "a", "99")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = feeds.incremental_index(stream, f"{tmp_path}/store", chunk, f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert got(spark.read.parquet(f"{tmp_path}/store/v1").select("file_path", "chunk_text")) == [("a", "99"), ("b", "1234")]


def test_job_states(spark, tmp_path):
    schema = "id string, status string, updated_at timestamp"
    spark.createDataFrame([("j", "pending", dt.datetime(2024, 1, 1)), ("j", "running", dt.datetime(2024, 1, 2))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = feeds.job_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("jobs_now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("jobs_now").select("id", "status", "n_changes")) == [("j", "running", 2)]
