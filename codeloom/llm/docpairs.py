"""Problem 1: functions paired with their documentation.

The state machines of functions.lexing tell strings and comments, which are blanked, so that declarations are found in what is
left, braces can be matched to delimit bodies, and a comment is known by its place. The comment
that stands directly before a declaration (or before its annotations), or the docstring of Python,
is its documentation; it is dropped if it says nothing.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import LEXERS, blanked
from codeloom.llm.parsing import LANGUAGES, Verdicts, extension, fault


class Pair(NamedTuple):
    name: str
    signature: str
    docstring: str
    start_line: int
    end_line: int


# --------------------------------------------------------------------------- lexing

_NEXT = re.compile(r"[ \t\r]*\n?[ \t]*")
_BLANKS = re.compile(r"\s*")
_ANNOTATION = re.compile(r"@(?!interface\b)[\w.$]+[ \t]*")


class Source:
    """A file with strings and comments blanked: text keeps every offset and line end."""

    def __init__(self, content: str, lang: str):
        self.content, self.lang = content, lang
        lexed = LEXERS[lang](content)
        self.comments = lexed.comments
        self.strings = dict(lexed.literals)
        self.text = blanked(content, lexed)
        self._ends = [m.start() for m in re.finditer("\n", content)]

    def line(self, at: int) -> int:
        """From 1."""
        return bisect_left(self._ends, at) + 1

    def closing(self, at: int) -> int:
        """The offset behind the bracket that closes the one at this offset, or the end."""
        open_, close = self.text[at], {"(": ")", "{": "}", "[": "]", "<": ">"}[self.text[at]]
        depth = 0
        for m in re.compile(f"[{re.escape(open_ + close)}]").finditer(self.text, at):
            depth += 1 if m.group() == open_ else -1
            if not depth:
                return m.end()
        return len(self.text)

    def documented(self) -> Iterator[tuple[str, int]]:
        """Each comment in /** */ with the offset of what follows on the same or the next line, annotations skipped."""
        for start, end in self.comments:
            if self.content.startswith("/**", start) and (m := _NEXT.match(self.text, end)):
                at = m.end()
                while note := _ANNOTATION.match(self.text, at):
                    at = note.end()
                    if self.text.startswith("(", at):
                        at = self.closing(at)
                    at = _BLANKS.match(self.text, at).end()  # type: ignore[union-attr]
                yield self.content[start:end], at

    def above(self, start: int) -> str | None:
        """The comment, in lines of // or in /* */, that ends in the line before the one that begins at start."""
        k = bisect_left(self.comments, (start,)) - 1
        if k < 0 or not _NEXT.fullmatch(self.text, self.comments[k][1], start) or "\n" not in self.text[self.comments[k][1] : start]:
            return None
        first, end = self.comments[k]
        if self.content.startswith("//", first):
            if self._behind_code(first):
                return None
            while k:  # the lines above
                ps, pe = self.comments[k - 1]
                if not self.content.startswith("//", ps) or not _NEXT.fullmatch(self.text, pe, first) or self._behind_code(ps):
                    break
                first, k = ps, k - 1
        return self.content[first:end]

    def _behind_code(self, at: int) -> bool:
        return bool(self.text[self.text.rfind("\n", 0, at) + 1 : at].strip())


# --------------------------------------------------------------------------- declarations

_PY_DEF = re.compile(r"^[ \t]*((?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*)", re.M)
_GO_FUNC = re.compile(r"^func[ \t]*(?:\([^()]*\)[ \t]*)?([^\W\d]\w*)[ \t]*(?=[\[(])", re.M)
_ID = r"(?:[^\W\d]|\$)[\w$]*"
_JS_FUNC = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*({_ID})\s*(?=[(<])")
_JS_BOUND = re.compile(rf"(?:export\s+)?(?:(?:const|let|var)\s+|(?:(?:public|private|protected|static|readonly|override)\s+)*)#?({_ID})\s*(?::[^=;]*(?:=>[^=;]*)?)?=\s*(?:async\b\s*)?(?=\(|<|function\b|{_ID}\s*=>)")
_JS_PROPERTY = re.compile(rf"({_ID})\s*:\s*(?:async\b\s*)?(?=function\b|\(|{_ID}\s*=>)")
_JS_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?\s*#?({_ID})\s*\??(?=[(<])")
_JS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "super", "with", "new", "await", "typeof", "throw", "import"}
_JAVA_METHOD = re.compile(
    rf"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>\s*)?(?:([\w$.]+(?:\s*<[^()=;{{}}]*>)?(?:\s*\[\s*\])*)\s+)?({_ID})\s*(?=\()"
)
_JAVA_WORDS = {"return", "new", "throw", "else", "case", "assert", "yield", "if", "for", "while", "switch", "catch", "try", "do", "synchronized", "this", "super", "package", "import", "instanceof", "class", "record", "enum", "interface"}
_AFTER_ARROW = re.compile(r"\s*(?::[^={]*(?:\{[^{}]*\}[^={]*)?)?=>")
_AFTER_METHOD = re.compile(r"\s*(?::[^;{}]*(?:\{[^{}]*\}[^;{}]*)?)?([{;])")
_AFTER_JAVA = re.compile(r"(?:\s*\[\s*\])*\s*(?:throws\s[\w\s.,]*|default\s[^;]*)?([{;])")
_TO_BODY = re.compile(r"[^;{}]*")


def _python(s: Source) -> Iterator[Pair]:
    text = s.text
    for m in _PY_DEF.finditer(text):
        at = m.end()
        if text.startswith("[", at):
            at = s.closing(at)
        if not text.startswith("(", at):
            continue
        end = s.closing(at)
        colon = text.find(":", end)
        if colon < 0:
            continue
        depth = 0
        for k in re.compile(r"[\[\](){}:\n]").finditer(text, end):  # the colon behind the returned type
            c = k.group()
            if c == ":" and not depth:
                colon = k.start()
                break
            depth += c in "[({"
            depth -= c in "])}"
        first = re.compile(r"[ \t\r\n\\]*").match(text, colon + 1).end()  # type: ignore[union-attr]
        doc, last = [], first
        while last in s.strings:
            doc.append(s.content[last : s.strings[last]])
            last = re.compile(r"[ \t]*").match(text, s.strings[last]).end()  # type: ignore[union-attr]
        if not doc or (last < len(text) and text[last] not in "\r\n;" and not _blank_to_line_end(s, last)):
            continue
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                value = ast.literal_eval(" ".join(doc))
        except (ValueError, SyntaxError, MemoryError):
            continue
        if isinstance(value, str):
            indent = len(m.group()) - len(m.group().lstrip(" \t"))
            body = re.compile(rf"^[ \t]{{0,{indent}}}[^ \t\r\n]", re.M).search(text, text.find("\n", colon) + 1 or len(text))
            stop = body.start() - 1 if body else len(text)
            yield Pair(m[2], re.sub(r"\s+", " ", s.content[m.start(1) : colon]), inspect.cleandoc(value), s.line(m.start(1)), s.line(len(text[:stop].rstrip()) - 1))


def _blank_to_line_end(s: Source, at: int) -> bool:
    end = s.text.find("\n", at)
    return not s.text[at : len(s.text) if end < 0 else end].strip()


def _brace(s: Source, name: str, start: int, at: int, doc: str) -> Pair:
    """at: where the body may begin."""
    stop = _TO_BODY.match(s.text, at).end()  # type: ignore[union-attr]
    end = s.closing(stop) if s.text.startswith("{", stop) else stop
    return Pair(name, re.sub(r"\s+", " ", s.content[start:stop]).strip(), clean(doc), s.line(start), s.line(max(start, end - 1)))


def _go(s: Source) -> Iterator[Pair]:
    for m in _GO_FUNC.finditer(s.text):
        if doc := s.above(m.start()):
            at = s.closing(m.end()) if s.text[m.end()] == "[" else m.end()
            yield _brace(s, m[1], m.start(), s.closing(at) if s.text.startswith("(", at) else at, doc)


def _script(s: Source) -> Iterator[Pair]:
    text = s.text
    for doc, start in s.documented():
        if m := _JS_FUNC.match(text, start):
            yield _brace(s, m[1], start, s.closing(text.index("(", m.end())), doc)
        elif m := _JS_BOUND.match(text, start) or _JS_PROPERTY.match(text, start):
            at = s.closing(m.end()) if text[m.end()] == "<" else m.end()
            if text.startswith("function", at):
                yield _brace(s, m[1], start, s.closing(text.index("(", at)), doc)
                continue
            end = s.closing(at) if text.startswith("(", at) else at
            if text.startswith("(", at) and not _AFTER_ARROW.match(text, end):
                continue
            yield _brace(s, m[1], start, text.index("=>", end) + 2, doc)
        elif (m := _JS_METHOD.match(text, start)) and m[1] not in _JS_WORDS:
            at = s.closing(m.end()) if text[m.end()] == "<" else m.end()
            if text.startswith("(", at):
                end = s.closing(at)
                after = _AFTER_METHOD.match(text, end)
                if after and (after[1] == "{" or (after[1] == ";" and s.lang == "typescript")):
                    yield _brace(s, m[1], start, end, doc)


def _java(s: Source) -> Iterator[Pair]:
    for doc, start in s.documented():
        m = _JAVA_METHOD.match(s.text, start)
        if m and m[2] not in _JAVA_WORDS and (m[1] or "").split("<")[0].strip() not in _JAVA_WORDS:
            end = s.closing(m.end())
            after = _AFTER_JAVA.match(s.text, end)
            if after and (after[1] == "{" or (after[1] == ";" and m[1])):
                yield _brace(s, m[2], start, end, doc)


_FINDERS = {"python": _python, "go": _go, "javascript": _script, "typescript": _script, "java": _java}

# --------------------------------------------------------------------------- documentation


def clean(comment: str) -> str:
    """A comment's text without its marks."""
    if comment.startswith("/*"):
        body = comment[2:-2] if comment.endswith("*/") and len(comment) > 3 else comment[2:]
        lines = [re.sub(r"^\s*\*+ ?", "", x) for x in body.lstrip("*").splitlines()]
    else:
        lines = [re.sub(r"^\s*//+ ?", "", x) for x in comment.splitlines()]
        lines = [x for x in lines if not re.match(r"(?:go:|nolint|line )", x)]
    return inspect.cleandoc("\n".join(lines)).strip()


_TAG = re.compile(r"\s*(?:[@\\][a-zA-Z]\w*|:\w+[^:\n]*:)")
# Headings of parameter lists, and beginnings of placeholders and licences.
_SECTION = re.compile(r"\s*(?:args|arguments|parameters|params|returns?|raises|yields|throws|attributes|keyword args|keyword arguments|other parameters)\s*:?\s*$", re.I)
_PLACEHOLDER = re.compile(r"\W*(?:todo|fixme|xxx|tbd|placeholder|auto-?generated|spdx-license-identifier|copyright\b|\(non-javadoc\)|\{?@inheritdoc\}?)", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def prose(doc: str) -> str:
    """Documentation without tag lines and parameter lists."""
    out: list[str] = []
    inside: int | None = None  # the indentation of a list's heading
    tag: int | None = None
    for line in doc.splitlines():
        depth = len(line) - len(line.lstrip())
        if not line.strip():
            tag = None
            out.append(line)
            continue
        if inside is not None:
            if depth > inside or re.match(r"\s*-{3,}\s*$", line):
                continue
            inside = None
        if _SECTION.match(line):
            inside = depth
            continue
        if _TAG.match(line):
            tag = depth
            continue
        if tag is not None and depth > tag:
            continue
        tag = None
        out.append(line)
    return "\n".join(out)


def real(name: str, doc: str) -> bool:
    """Whether documentation says something: five different words beyond those of the name, and no placeholder."""
    text = prose(doc)
    if _PLACEHOLDER.match(text):
        return False
    own = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+", name)} | {w.lower() for w in re.findall(r"[^\W\d_]+", name)}
    return len({w.lower() for w in _WORD.findall(text)} - own) >= 5


def pairs(content: str, lang: str) -> list[Pair]:
    """The documented functions of a file, in order; nothing if it does not parse."""
    found = [p for p in _FINDERS[lang](Source(content, lang)) if real(p.name, p.docstring)]
    return found if found and fault(content, lang) is None else []


SCHEMA = "repo_id string, file_path string, symbol_name string, signature string, docstring string, start_line int, end_line int"


def extract(df: DataFrame) -> DataFrame:
    """repo_id, file_path, symbol_name, signature, docstring, start_line and end_line of the documented functions of df.

    df has repo_id, file_path and content; others are not read. Null content and other extensions
    than those of Python, JavaScript, TypeScript, Go and Java give no rows, as do files that do
    not parse. A file that was scanned twice gives its rows twice. One stage without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Verdicts[list[Pair]] = Verdicts(pairs)  # copies of a text are read once in a task
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for repo, path, content, lang in zip(*[c.to_pylist() for c in b.slice(k, 256).columns], strict=True):
                    out += [(repo, path, *p) for p in known(content, lang)]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                types = [pa.string()] * 5 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["repo_id", "file_path", "symbol_name", "signature", "docstring", "start_line", "end_line"])

    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() if kv[1] != "json" for x in kv]), extension(F.col("file_path")))
    rows = df.select("repo_id", "file_path", "content", lang.alias("lang")).where("lang is not null and content is not null")
    return rows.mapInArrow(run, SCHEMA)
