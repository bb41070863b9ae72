"""What the state machines and the grammars make of nesting, of slashes, and of what Python's own parser decides."""

from __future__ import annotations

import ast
import random
import sysconfig
import warnings
from pathlib import Path

import pytest

from codeloom.functions import lexing
from codeloom.llm import docpairs, parsing


def accepts(text: str, lang: str) -> bool:
    return parsing.fault(text, lang) is None


@pytest.mark.parametrize(
    "lang, text",
    [
        ("javascript", "x = `${`${`${a}`}`}`;"),
        ("javascript", "x = `${ {a: {b: 1}}.a.b } and ${ f({c: `}`}) }`;"),
        ("javascript", "if (a) /re[/`]/.test(b);\nwhile (x) /y/g.exec(z)\nfunction f() { }\n/q`/.test(a)"),
        ("javascript", "x = a / b / c; y = { a: 1 } / 2; z = s.return / 3; w = (a + b) / 2 / d; v = a++ / 2"),
        ("javascript", "for (let " + ", ".join(f"a{i} = {i}" for i in range(250)) + "; a1; a2++) { }"),
        ("javascript", "x = " + "(" * 250 + "1" + ")" * 250),
        ("javascript", "import a from 'b'; export const c = await a;"),
        ("javascript", "with (a) { b }"),
        ("typescript", "const x = <Map<string, number>>y; type A = `a${B}c`; const z = <T,>(q: T) => <const>['a'];"),
        ("json", "[" * 250 + "]" * 250),
        ("java", "@A open module a.b { requires transitive c; exports d to e, f; }"),
        ("java", "package a; import b; import static c.D.*; class E { } interface F { }"),
        ("python", "f(lambda x, y=1, /, *a, b, **c: x, " + "1, " * 150 + "*z)\n"),
        ("python", "x = [" + "a, " * 5000 + "]\ny = " + "b, " * 5000 + "\n"),
        ("python", "x = f\"{d[\"k\"]!r:>{w}.{p}} {{}} {y=} {f'{z:%Y-%m}'}\" rf'\\d{a}' '''q'''\n"),
        ("python", "x = " + "(" * 150 + "1" + ")" * 150 + "\n"),
        ("python", "def f(a, /, b=1, *, c, **d): pass\nf(a, *b, c=1, *d, **e, g=2)\n"),
    ],
)
def test_valid(lang, text):
    assert accepts(text, lang)


@pytest.mark.parametrize(
    "lang, text",
    [
        ("javascript", "x = `${`${a}`"),
        ("javascript", "x = `${a b}`"),
        ("javascript", "x = `a${}`"),
        ("javascript", "x = a / b /"),
        ("javascript", "for (let " + ", ".join(f"a{i} = {i}" for i in range(250)) + ",; a1; a2++) { }"),
        ("javascript", "x = " + "(" * 250 + "1" + ")" * 249),
        ("javascript", "import a from 'b'; with (a) { }"),
        ("java", "class A { }\nimport b;"),
        ("java", "module a { }\nclass B { }"),
        ("java", "import b;\npackage a;"),
        ("python", "f(**a, *b)\n"),
        ("python", "f(a=1, 2)\n"),
        ("python", "f(x for x in y, 1)\n"),
        ("python", "def f(a=1, b): pass\n"),
        ("python", "def f(*): pass\n"),
        ("python", "lambda a=1, b: a\n"),
        ("python", "x = f'{a b}'\n"),
        ("python", "x = f'{}'\n"),
        ("python", "x = f'{a!z}'\n"),
        ("python", "try: pass\nexcept A, e: pass\n"),
        ("python", "x = 012\n"),
        ("python", "x = 'C:\\Users'\n"),
        ("python", "x = 'a' b'b'\n"),
        ("python", "x := 1\n"),
        ("python", "(*a)\n"),
        ("python", "{a: 1, b}\n"),
    ],
)
def test_invalid(lang, text):
    assert not accepts(text, lang)


def _parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


def test_python_equals_the_platform_on_mutated_modules():
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::4]
    texts = [f.read_text(errors="replace") for f in files]
    assert all(accepts(t, "python") == _parses(t) for t in texts)
    rng = random.Random(11)
    tokens = "( ) [ ] { } : , = ' \" + - * ** @ / // . ... -> := == < not in is and or if else for while lambda x 1 'a' b'a' f'{x}' None await async yield return del import from as with try except def class pass match case type global ; \\ ! ~".split()
    for _ in range(1500):
        lines = rng.choice(texts).split("\n")
        k = rng.randrange(len(lines))
        part = lines[max(0, k - 8) : k + 8]
        depth = min((len(x) - len(x.lstrip()) for x in part if x.strip()), default=0)
        part = [x[depth:] for x in part]
        j = rng.randrange(len(part))
        at = rng.randrange(len(part[j]) + 1)
        part[j] = rng.choice([part[j][:at], part[j][:at] + " " + rng.choice(tokens) + " " + part[j][at:], part[j][:at] + part[j][at + 1 :], "  " + part[j]])
        text = "\n".join(part) + "\n"
        assert accepts(text, "python") == _parses(text), text


def test_spans():
    text = "x = `a${b /* c */}d` // e\ny = /`/; z = 'q'"
    lexed = lexing.script(text)
    assert [text[a:b] for a, b in lexed.comments] == ["/* c */", "// e"]
    assert [text[a:b] for a, b in lexed.literals] == ["`a${", "}d`", "/`/", "'q'"]
    text = "x = f'{a}' \"b\"  # c\n"
    lexed = lexing.python(text)
    assert [text[a:b] for a, b in lexed.comments + lexed.literals] == ["# c", "f'{a}'", '"b"']


def test_functions_bound_to_properties():
    doc = "/** Splits the input at every second comma found. */\n"
    text = f"const o = {{\n{doc}cut: function (a) {{ return `${{`}}`}}`; }},\n{doc}join: async (a) => a,\n{doc}size: 3,\n}};\n"
    assert [(p.name, p.start_line) for p in docpairs.pairs(text, "javascript")] == [("cut", 3), ("join", 5)]


def test_copies_are_read_once():
    calls = []
    known = parsing.Verdicts(lambda text, lang: calls.append(text) or len(text), kept=2)
    assert [known(t, "go") for t in ("a", "bb", "a", "ccc", "a")] == [1, 2, 1, 3, 1] and calls == ["a", "bb", "ccc", "a"]
