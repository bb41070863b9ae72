"""Symbols, imports and calls against Python's own parser, and on fixtures of other languages."""

from __future__ import annotations

import ast
import sysconfig
import warnings
from pathlib import Path

import pytest

from codeloom.operators import extraction
from codeloom.operators.extraction import Reader


def test_python_against_the_platform():
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::5]
    for f in files:
        text = f.read_text(errors="replace")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        expected, stack = [], [(tree, None, "")]
        while stack:
            node, parent, kind = stack.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    is_class = isinstance(child, ast.ClassDef)
                    expected.append((child.name, "class" if is_class else "method" if kind == "class" else "function", parent, child.lineno, child.end_lineno, len(child.decorator_list)))
                    stack.append((child, child.name, "class" if is_class else "function"))
                else:
                    stack.append((child, parent, kind))
        found = [(s.symbol_name, s.symbol_type, s.parent_name, s.start_line, s.end_line, len(s.decorators)) for s in Reader(text, "python").symbols]
        assert sorted(found, key=str) == sorted(expected, key=str), f


@pytest.mark.parametrize(
    "lang, text, expected",
    [
        ("javascript", "export class A extends B {\n  static async load(x, { y }) {\n    if (x) { return `}`; }\n  }\n}\nconst f = async (a, b) => {\n};\nfunction g(a) { }\nlet h = function (q) { };\n", [("A", "class", None, 1, 5), ("load", "method", "A", 2, 4), ("f", "function", None, 6, 7), ("g", "function", None, 8, 8), ("h", "function", None, 9, 9)]),
        ("typescript", "@dec({ a: 1 })\nexport class A<T> implements B, C<T> {\n  private get<U>(x: Map<string, U>): U {\n    return x as U;\n  }\n}\ninterface I { }\n", [("A", "class", None, 2, 6), ("get", "method", "A", 3, 5), ("I", "interface", None, 7, 7)]),
        ("go", "package p\n\nimport (\n\t\"fmt\"\n)\n\ntype U struct {\n}\n", [("U", "struct", None, 7, 8)]),
        ("go", "package p\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Sum(xs []int) int {\n\tfor _, x := range xs {\n\t}\n\treturn 0\n}\n\nfunc F[K any](k K) {}\n", [("T", "struct", None, 3, 5), ("Sum", "method", "T", 7, 11), ("F", "function", None, 13, 13)]),
        ("java", "class A extends B implements C {\n    @Override\n    public List<Map<String, Integer>> sum(int a)\n            throws E {\n        if (a > 0) { return null; }\n        return null;\n    }\n    enum K { X }\n}\n", [("A", "class", None, 1, 9), ("sum", "method", "A", 3, 7), ("K", "enum", "A", 8, 8)]),
        ("c", "static int add(int a, int b)\n{\n  while (a) { }\n  return a;\n}\n", [("add", "function", None, 1, 5)]),
        ("rust", "impl Foo for Bar {\n  fn go(&self) -> i32 { 1 }\n}\n", [("Bar", "impl", None, 1, 3), ("go", "method", "Bar", 2, 2)]),
        ("csharp", "namespace N {\n  public class A : B, IC {\n    public int F(int x) { return x; }\n  }\n}\n", [("N", "namespace", None, 1, 5), ("A", "class", "N", 2, 4), ("F", "method", "A", 3, 3)]),
    ],
)
def test_blocks(lang, text, expected):
    assert [(s.symbol_name, s.symbol_type, s.parent_name, s.start_line, s.end_line) for s in Reader(text, lang).symbols] == expected


def test_attributes():
    a = Reader("class A extends B implements C, D<E> {\n  f(int a, Map<K, V> b) { }\n}\n", "java").symbols
    assert a[0].bases == ["B", "C", "D<E>"] and a[1].parameters == ["int a", "Map<K, V> b"]
    p = Reader("@x(1)\n@y\nclass A(B, metaclass=C):\n    def f(self, a: int = (1, 2)): return g(h.i(a))\n", "python")
    assert p.symbols[0].bases == ["B", "metaclass=C"] and p.symbols[0].decorators == ["x(1)", "y"] and p.symbols[1].parameters == ["self", "a: int = (1, 2)"]
    assert list(p.calls()) == [(None, "x", None, 1), ("f", "g", None, 4), ("f", "i", "h", 4)]


@pytest.mark.parametrize(
    "lang, text, expected",
    [
        ("python", "import a.b as c, d\nfrom .e import (f,\n    g as h)\n# import z\n", [("a.b", None), ("d", None), (".e", "f"), (".e", "g")]),
        ("typescript", "import x, { y } from './a';\nimport 'b';\nexport * from \"c\";\nconst z = require('d');\n", [("./a", None), ("b", None), ("c", None), ("d", None)]),
        ("go", "package p\n\nimport \"a\"\nimport (\n\tx \"b/c\"\n)\n", [("a", None), ("b/c", None)]),
        ("java", "import a.B;\nimport static c.D.*;\n", [("a.B", None), ("c.D.*", None)]),
        ("rust", "use a::b;\n", [("a::b", None)]),
        ("c", "#include <a.h>\n", [("a.h", None)]),
    ],
)
def test_imports(lang, text, expected):
    assert [(m, n) for m, n, _ in Reader(text, lang).imports()] == expected


def test_rows(spark):
    rows = [("r", "a.py", "from b import B\n\n\nclass A(B):\n    def f(self):\n        return g()\n"), ("r", "b.py", "class B:\n    pass\n"), ("r", "c.txt", "class X"), ("r", "d.py", None), ("r", None, "class Y: pass"), ("q", "b.py", "class B: pass\n")]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string")
    found = extraction.symbols(df)
    assert sorted((r["file_path"], r["symbol_name"]) for r in found.collect()) == [("a.py", "A"), ("a.py", "f"), ("b.py", "B"), ("b.py", "B")]
    assert [tuple(r) for r in extraction.inheritance(found).collect()] == [("r", "a.py", "A", "B", "b.py")]
    assert [tuple(r) for r in extraction.uses(found, extraction.imports(df)).collect()] == [("r", "a.py", "A", "B", "b.py")]
    assert [tuple(r)[3:] for r in extraction.calls(df).collect()] == [("f", "g", None, 6)]
    assert extraction.symbols(df.limit(0)).isEmpty()
