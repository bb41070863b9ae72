"""Reading files, and what the line patterns find in them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codeloom.operators import symbols
from codeloom.sources import files


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan_and_detect(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {"main.py": b"def hello(): pass\n", "a/utils.py": "é = 1\n".encode(), "node_modules/x.py": b"x", "img.png": b"\x89PNG", "bin.py": b"a\x00b", "doc.md": b"one two three", ".git/c.py": b"x", "empty.py": b"", "late.py": b"x" * 9000 + b"\x00"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    out = files.scan(spark, str(root))
    assert got(out.select("file_path", "size_bytes")) == [("a/utils.py", 7), ("doc.md", 13), ("late.py", 9001), ("main.py", 18)]
    assert got(out.where("file_path = 'a/utils.py'").select("content")) == [("é = 1\n",)]
    kinds = got(files.detect(out, ["a/*"]).select("file_path", "kind", "ignored", "n_words"))
    assert kinds[0] == ("a/utils.py", "code", True, 3) and kinds[1] == ("doc.md", "document", False, 3)


def test_playbooks(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\nname: \"find\"\ncategory: search\n---\n# Find\n## When to use\nwhen lost\n## Anti-patterns\n- guess\n- * wait\n")
    row = files.playbooks(spark, str(tmp_path)).first()
    assert (row["name"], row["category"], row["version"], row["when_to_use"], row["anti_patterns"]) == ("find", "search", "", "when lost", ["guess", "* wait"])


def test_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}))
    nodes, edges = files.graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and got(edges.select("u", "v", "relation")) == [("a", "b", "calls")]


def test_pages(spark):
    df = spark.createDataFrame([("https://a.org/x", "<title>T</title><p>b</p>"), ("http://10.0.0.1/", "x")], "url string, html string")
    assert got(files.pages(df).select("title", "text")) == [("T", "T b")]


REPO = {
    "main.py": ("python", "import os\nfrom pkg.utils import make\n\nclass Sample:\n    def greet(self):\n        # NOTE: stays polite\n        return make(self.name())\n\ndef hello():\n    greet()\n"),
    "src/pkg/utils.py": ("python", "def make(x):\n    return x\n"),
    "web/a.js": ("javascript", "import { b } from './lib/b';\nconst c = require('../web/c');\nexport function run() {\n  b(1);\n}\n"),
    "web/lib/b.ts": ("typescript", "export interface B { }\n"),
    "web/c/index.js": ("javascript", ""),
    "m.go": ("go", "package m\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Run() {\n\tfmt.Println()\n}\n"),
    "src/main/java/a/B.java": ("java", "package a;\nimport a.C;\npublic class B {\n    public static int f(int x) {\n        return g(x);\n    }\n}\n"),
    "src/main/java/a/C.java": ("java", "package a;\nclass C { }\n"),
}


def test_symbols(spark):
    df = spark.createDataFrame([("r", p, lang, text) for p, (lang, text) in REPO.items()], "repo_id string, file_path string, language string, content string")
    names = got(symbols.declarations(df).select("symbol_name", "symbol_type", "start_line"))
    assert names == sorted([("B", "class", 1), ("B", "class", 3), ("C", "class", 2), ("Run", "function", 10), ("Sample", "class", 4), ("T", "class", 7), ("f", "function", 4), ("greet", "function", 5), ("hello", "function", 9), ("make", "function", 1), ("run", "function", 3)])
    found = symbols.imports(df)
    assert got(found.select("module")) == [("../web/c",), ("./lib/b",), ("a.C",), ("fmt",), ("os",), ("pkg.utils",)]
    assert got(symbols.resolve_imports(found, df).select("module", "target")) == [("../web/c", "web/c/index.js"), ("./lib/b", "web/lib/b.ts"), ("a.C", "src/main/java/a/C.java"), ("pkg.utils", "src/pkg/utils.py")]
    calls = got(symbols.call_sites(df).select("caller", "callee", "line_no"))
    assert ("greet", "make", 7) in calls and ("greet", "name", 7) in calls and ("hello", "greet", 10) in calls and ("run", "b", 4) in calls and ("f", "g", 5) in calls
    assert got(symbols.rationale(df).select("line_no", "kind", "label")) == [(6, "NOTE", "stays polite")]
    assert symbols.declarations(df.limit(0)).isEmpty()


def test_visibility(spark):
    df = spark.createDataFrame([("__x", "python"), ("_x", "python"), ("__init__", "python"), ("Run", "go"), ("run", "go"), ("f", "java")], "n string, l string")
    assert [r[0] for r in df.select(symbols.visibility(F.col("n"), F.col("l"))).collect()] == ["private", "protected", "protected", "public", "private", "public"]
