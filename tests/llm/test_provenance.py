"""Attribute files with their precedence, and leading comments of any length."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.llm import provenance
from codeloom.llm.provenance import Declarations, header, rules

SAID = [
    ("", "*.py linguist-generated\nsrc/mine.py -linguist-generated\n# *.go linguist-generated\n!x linguist-generated\n\"a b.py\" linguist-vendored text=auto\n*.pb.* linguist-generated=true\n"),
    ("lib", "*.py linguist-vendored=false\n*.go linguist-vendored\n"),
    ("lib/deep", "*.py !linguist-generated\n/top.go -linguist-vendored\n"),
    ("third", "** linguist-vendored\nown/** -linguist-vendored\nown/not.js linguist-vendored\n"),
]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("x.py", True), ("src/mine.py", False), ("src/other.py", True), ("y.go", None), ("a b.py", True), ("q/x.pb.go", True),
        ("lib/y.py", True), ("lib/y.go", True), ("lib/deep/y.py", False), ("lib/deep/top.go", False), ("lib/deep/z/top.go", True),
        ("third/a/b.js", True), ("third/own/b.js", False), ("third/own/not.js", True), ("third", None),
    ],
)
def test_precedence(path, expected):
    says = Declarations([(d, *r) for d, text in SAID for r in rules(text)])
    assert says(path) is expected


def test_rules_in_several_chunks(spark):
    """The lines count within the file, whatever chunk they stand in."""
    rows = [("r", ".gitattributes", "*.py -linguist-generated\n", 9), ("r", ".gitattributes", "*.py linguist-generated\n", 1), ("r", "a.py", "x = 1", 1), ("r", "b.go", "x", 1), ("q", "a.py", "x", 1), ("q", ".gitattributes", None, 1), (None, ".gitattributes", "*", 1)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, chunk_text string, start_line int")
    files = df.where("repo_id is not null").select("repo_id", "file_path").distinct()
    assert [tuple(r) for r in provenance.declared(df, files).collect()] == [("r", "a.py", False)]
    assert provenance.declared(df.where("repo_id = 'q'"), files).isEmpty()


LICENCE = "\n".join(f"# Line {'i' * i} of a licence that goes on for a while." for i in range(40))


@pytest.mark.parametrize(
    "text, expected",
    [
        (LICENCE + "\n# Code generated by x. DO NOT EDIT.\nx = 1", (True, False, False)),
        ("/*\n licence\n\n Code generated by x.\n */\nint x;", (True, False, False)),
        ("/* a */ int x; // generated by y", (False, False, False)),
        ("'''\nGenerated by tools/x\n'''\nx = 1", (True, False, False)),
        ("x = 1\n# generated by y", (False, False, False)),
        ("/* a\n b", (False, False, True)),
        ("// widget v1.2.3\n", (False, True, True)),
    ],
)
def test_headers(text, expected):
    assert header(text.split("\n"), "lib/widget.js") == expected


def test_header_over_chunks(spark):
    rows = [("r", "a.py", LICENCE, 1), ("r", "a.py", "# Code generated by x. DO NOT EDIT.\n\nx = 1", 41), ("r", "b.c", "/*\n text", 1), ("r", "b.c", "more\n*/\nint x; // generated by y", 3), ("r", "c.py", LICENCE, 1), ("r", "c.py", "# Code generated by x. DO NOT EDIT.\n", 90)]
    rows += [("r", "d.c", "/*\n text", 1), ("r", "d.c", "generated by z\n*/\nint x;", 4), ("r", "e.py", "\n".join(f"# {'i' * i}" for i in range(20)), 1), ("r", "e.py", "# Code generated by x. DO NOT EDIT.", 22)]
    df = spark.createDataFrame(rows * 2, "repo_id string, file_path string, chunk_text string, start_line int")
    up = spark.createDataFrame([], "content string")
    found = provenance.evidence(df, up).where("evidence").select(F.col("file_path")).collect()
    assert sorted(r[0] for r in found) == ["a.py", "d.c", "e.py"]
