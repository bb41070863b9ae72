"""Symbols, imports and calls of source files, by their place in blocks: parents, bases, parameters, decorators and last lines.

Strings and comments are blanked by the state machines of functions.lexing first. In Python blocks are
told by their indents, elsewhere by braces: what stands before a brace tells what the block is. Files
are read in narrow stages, each as a whole by one small program.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import LEXERS, Lexed, blanked

# The language of each extension that is read, and the lexer that tells its strings and comments.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "kt": "kotlin", "scala": "scala", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift",
}
_LEXER = {"python": "python", "javascript": "javascript", "typescript": "typescript", "go": "go"}
# Words before a bracket that call nothing, and before a brace that declare nothing.
_WORDS = {
    "if", "for", "while", "switch", "catch", "return", "with", "and", "or", "not", "in", "is", "elif", "assert", "del", "print", "lambda", "yield", "await", "raise", "except", "def", "class", "function", "func",
    "fn", "new", "typeof", "throw", "super", "this", "else", "do", "try", "case", "when", "match", "synchronized", "using", "lock", "foreach", "sizeof", "go", "defer", "select", "import", "from", "as", "void", "var", "let", "const",
}


_BY_LINE = {"go", "javascript", "typescript", "kotlin", "scala", "swift"}


class _Moved:
    """A match in a text that begins later."""

    def __init__(self, match: re.Match[str], by: int):
        self.match, self.by = match, by

    def __getitem__(self, group: int) -> str:
        return self.match[group]

    def start(self, group: int) -> int:
        return self.match.start(group) - self.by


class Symbol(NamedTuple):
    symbol_name: str
    symbol_type: str
    parent_name: str | None
    signature: str
    parameters: list[str]
    bases: list[str]
    decorators: list[str]
    start_line: int
    end_line: int
    start: int
    end: int
    name_at: int


_ID = r"[^\W\d][\w$]*"
_PY = re.compile(rf"^([ \t]*)((?:async[ \t]+)?def|class)[ \t]+({_ID})", re.M)
_CLASS = re.compile(rf"(?:^|[\s;}}])(?:(class|interface|enum|struct|trait|record|object|protocol|namespace|module|union)\s+|type\s+(?={_ID}(?:\[[^\]]*\])?\s+(?:struct|interface)\b)|impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?)({_ID})([\s\S]*)$")
_FUNCTION = re.compile(rf"(?:^|\s)(?:function\b\s*\*?|func\b(?:\s*\([^()]*\))?|fn\b|fun\b|def\b)\s*({_ID})\s*(?:<[^()]*>|\[[^()]*\])?\s*(?=\()")
_ARROW = re.compile(rf"(?:(?:const|let|var)\s+|^\s*(?:(?:public|private|protected|static|readonly)\s+)*)({_ID})\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*)?(?:\([\s\S]*\)\s*(?::[^=]*)?|{_ID}\s*)(?:=>)?\s*$")
_METHOD = re.compile(rf"(?:^|[\s*&~#])({_ID})\s*(?:<[^()]*>)?\s*\([\s\S]*\)\s*(?:(?:throws|const|noexcept|override|final|where|->|:)[\s\S]*)?$")
_BASES = re.compile(r"\b(?:extends|implements|with)\b|:(?!:)")
_ANNOTATION = re.compile(r"\s*@(?!interface\b)([\w.$]+)[ \t]*(?=(\()?)")
_RECEIVER = re.compile(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)")


def _closing(text: str, at: int) -> int:
    """The offset behind the bracket that closes the one at this offset, or the end."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    open_, close, depth = text[at], pairs[text[at]], 0
    for m in re.compile(f"[{re.escape(open_ + close)}]").finditer(text, at):
        depth += 1 if m.group() == open_ else -1
        if not depth:
            return m.end()
    return len(text)


def _split(text: str) -> list[str]:
    """The parts between commas that stand in no bracket."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[i - 1 : i] not in ("-", "="))
        if c == "," and depth <= 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in (*out, text[start:].strip()) if x]


class Reader:
    """A file with its symbols in the order of their places."""

    def __init__(self, content: str, lang: str):
        self.content, self.lang = content, lang
        lexed: Lexed = LEXERS[_LEXER.get(lang, "java")](content)
        self.text = blanked(content, lexed)
        self._ends = [m.start() for m in re.finditer("\n", content)]
        self.symbols = sorted(self._python() if lang == "python" else self._braces(), key=lambda s: (s.start, -s.end))

    def line(self, at: int) -> int:
        return bisect_left(self._ends, at) + 1

    def _parameters(self, at: int) -> list[str]:
        at = self.text.find("(", at)
        return _split(self.text[at + 1 : _closing(self.text, at) - 1]) if at >= 0 else []

    def _python(self) -> Iterator[Symbol]:
        text = self.text
        lines = [(m.start(), len(m[1].expandtabs())) for m in re.finditer(r"^([ \t]*)[^\s]", text, re.M)]
        starts = [s for s, _ in lines]
        # a line within brackets is no line of its own
        depth, inside = 0, []
        for m in re.finditer(r"[\[\](){}]|^[ \t]*\S", text, re.M):
            t = m.group()
            if t[-1] in "([{" or t[-1] in ")]}":
                if len(t) > 1 or m.start() in starts:
                    inside.append((m.start(), depth > 0))
                depth += 1 if t[-1] in "([{" else -1
            else:
                inside.append((m.start(), depth > 0))
        within = dict(inside)
        open_: list[tuple[int, str, str, int]] = []  # indent, name, kind and end of the blocks around
        for m in _PY.finditer(text):
            indent = len(m[1].expandtabs())
            k = bisect_right(starts, m.start())
            after = m.end()
            if text.startswith("[", after):
                after = _closing(text, after)
            listed = _split(text[after + 1 : _closing(text, after) - 1]) if text.startswith("(", after) else []
            colon = text.find(":", _closing(text, after) if text.startswith("(", after) else after)
            low = bisect_right(starts, max(colon, m.start()))
            while low < len(lines) and (within.get(lines[low][0], False) or lines[low][1] > indent):
                low += 1
            end = len(text[: lines[low][0] if low < len(lines) else len(text)].rstrip())
            while open_ and (open_[-1][0] >= indent or open_[-1][3] <= m.start()):
                open_.pop()
            parent = open_[-1] if open_ else None
            kind = "class" if m[2] == "class" else "method" if parent and parent[2] == "class" else "function"
            notes, at = [], k - 2
            while at >= 0 and lines[at][1] == indent and text.startswith("@", lines[at][0] + len(m[1])):
                notes.insert(0, self.content[lines[at][0] : starts[at + 1]].strip().lstrip("@"))
                at -= 1
            signature = re.sub(r"\s+", " ", self.content[m.start(2) : colon if colon > 0 else m.end()])
            yield Symbol(m[3], kind, parent[1] if parent else None, signature, [] if kind == "class" else listed, listed if kind == "class" else [], notes, self.line(m.start(2)), self.line(max(m.start(2), end - 1)), m.start(2), end, m.start(3))
            open_.append((indent, m[3], kind, end))

    def _braces(self) -> Iterator[Symbol]:
        text = self.text
        stack: list[tuple[str, str, int]] = []  # kind and name of the open blocks, and where the place behind begins
        begin = parens = 0
        kept: list[tuple[int, int]] = []
        for m in re.finditer(r"[{};()]", text):
            c = m.group()
            if c in "()":
                parens = max(0, parens + (1 if c == "(" else -1))
            elif c == ";":
                begin = m.end() if not parens else begin
            elif c == "{":
                found = self._block(begin, m.start(), stack)
                if found:
                    end = _closing(text, m.start())
                    yield found._replace(end=end, end_line=self.line(end - 1))
                stack.append((found.symbol_type, found.symbol_name, begin) if found else ("", "", begin))
                kept.append((parens, begin))
                begin, parens = m.end(), 0
            else:
                if stack:
                    stack.pop()
                    parens, before = kept.pop()
                    begin = before if parens else m.end()

    def _block(self, low: int, high: int, stack: list[tuple[str, str, int]]) -> Symbol | None:
        head = self.text[low:high]
        notes = []
        while a := _ANNOTATION.match(head):
            cut = _closing(head, a.end()) if a[2] else a.end()
            notes.append(self.content[low : low + cut].strip().lstrip("@"))
            head, low = head[cut:], low + cut
        lead = len(head) - len(head.lstrip())
        head, low = head[lead:].rstrip(), low + lead
        around = next(((k, n) for k, n, _ in reversed(stack) if k), ("", ""))
        direct = stack[-1][0] if stack else ""
        named: re.Match[str] | None
        if (named := _CLASS.search(head)) and "(" not in head[head.rfind("\n", 0, named.start(2)) + 1 : named.start(2)]:
            kind = named[1] or ("impl" if "impl" in head[: named.start(2)] else "interface" if re.search(r"\binterface\b", named[3]) else "struct")
            parts = _BASES.split(named[3].split("{")[0])[1:] if self.lang != "go" else []
            bases = [b for p in parts for b in _split(re.sub(r"\b(?:permits|where)\b[\s\S]*|\b(?:public|private|protected|virtual)\b", "", p))]
            return self._symbol(named, 2, kind, around[1] or None, head, low, [], bases, notes)
        if named := _FUNCTION.search(head):
            receiver = _RECEIVER.match(head) if self.lang == "go" else None
            parent = receiver[1] if receiver else around[1] or None
            kind = "method" if receiver or (direct and direct not in ("function", "method", "namespace", "module")) else "function"
            return self._symbol(named, 1, kind, parent, head, low, self._parameters(low + named.end()), [], notes)
        if self.lang in ("javascript", "typescript") and (named := _ARROW.search(head)) and ("=>" in head or "function" in head):
            return self._symbol(named, 1, "method" if direct == "class" else "function", around[1] or None, head, low, self._parameters(low + head.index("=", named.end(1) - named.start())), [], notes)
        in_class = direct not in ("", "function", "method")
        if (in_class or (self.lang in ("c", "cpp") and not stack)) and (named := _METHOD.search(head)) and named[1] not in _WORDS and "=" not in head[: named.start(1)]:
            return self._symbol(named, 1, "method" if in_class and direct not in ("namespace", "module") else "function", around[1] or None, head, low, self._parameters(low + named.end(1)), [], notes)
        return None

    def _symbol(self, m: re.Match[str] | _Moved, group: int, kind: str, parent: str | None, head: str, low: int, parameters: list[str], bases: list[str], notes: list[str]) -> Symbol:
        if self.lang in _BY_LINE:  # a line end may have ended what stands before
            lead = head.rfind("\n", 0, m.start(group)) + 1
            lead += len(head[lead:]) - len(head[lead:].lstrip())
            low, head, m = low + lead, head[lead:], _Moved(m, lead)
        return Symbol(m[group], kind, parent, re.sub(r"\s+", " ", self.content[low : low + len(head)]), parameters, bases, notes, self.line(low), 0, low, 0, low + m.start(group))

    def imports(self) -> Iterator[tuple[str, str | None, int]]:
        """Module, imported name or null, and line."""
        text, content = self.text, self.content
        if self.lang == "python":
            for m in re.finditer(r"^[ \t]*import[ \t]+([^\n;#]+)", text, re.M):
                for part in m[1].split(","):
                    yield part.split(" as ")[0].strip(), None, self.line(m.start(1))
            for m in re.finditer(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]*(\([^)]*\)|[^\n;#]+)", text, re.M):
                for part in m[2].strip("()").replace("\\", " ").split(","):
                    if part.strip():
                        yield m[1], part.split(" as ")[0].strip(), self.line(m.start(1))
        elif self.lang in ("javascript", "typescript"):
            for m in re.finditer(r"\b(?:import|export)\b(?:[^\"';]*?\bfrom)?\s*(\"[^\"]*\")|\b(?:require|import)\s*\(\s*(\"[^\"]*\")\s*\)", text):
                g = 1 if m[1] else 2
                yield content[m.start(g) + 1 : m.end(g) - 1], None, self.line(m.start(g))
        elif self.lang == "go":
            for m in re.finditer(r"^import[ \t]*(?:\(([^)]*)\)|[^\"\n]*\"[^\"]*\")", text, re.M):
                for x in re.finditer(r"\"[^\"\n]*\"", m.group()):
                    yield content[m.start() + x.start() + 1 : m.start() + x.end() - 1], None, self.line(m.start() + x.start())
        else:
            word = {"rust": "use", "csharp": "using", "php": "use", "swift": "import", "c": "#[ \\t]*include", "cpp": "#[ \\t]*include"}.get(self.lang, "import")
            for m in re.finditer(rf"^[ \t]*{word}[ \t]+(?:static[ \t]+)?([^;\n]+)", text, re.M):
                yield content[m.start(1) : m.end(1)].strip().strip("<>\"'"), None, self.line(m.start(1))

    def calls(self) -> Iterator[tuple[str | None, str, str | None, int]]:
        """Caller (the innermost function around, or null), callee, what stands before its dot, and line."""
        functions = [s for s in self.symbols if s.symbol_type in ("function", "method")]
        own = {s.name_at for s in self.symbols}
        open_: list[Symbol] = []
        k = 0
        for m in re.finditer(rf"(?:({_ID})\s*(?:\.|::|->|\?\.)\s*)?({_ID})\s*\(", self.text):
            if m[2] in _WORDS or m.start(2) in own:
                continue
            while k < len(functions) and functions[k].start <= m.start(2):
                open_.append(functions[k])
                k += 1
            while open_ and open_[-1].end <= m.start(2):
                open_.pop()
            yield open_[-1].symbol_name if open_ else None, m[2], m[1], self.line(m.start(2))


def _run(df: DataFrame, columns: list[tuple[str, str, pa.DataType]], rows: Callable[[Reader], Iterator[tuple]]) -> DataFrame:
    names = ["repo_id", "file_path", "language", *[c for c, _, _ in columns]]
    types = [pa.string()] * 3 + [t for _, _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out = [(repo, path, lang, *r) for repo, path, content, lang in zip(*[c.to_pylist() for c in b.slice(k, 256).columns], strict=True) for r in rows(Reader(content, lang))]
                cols = list(zip(*out, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending)
    files = df.select("repo_id", "file_path", "content", lang.alias("lang")).where("lang is not null and content is not null")
    return files.mapInArrow(run, "repo_id string, file_path string, language string, " + ", ".join(f"{c} {t}" for c, t, _ in columns))


def symbols(df: DataFrame) -> DataFrame:
    """The symbols of each file of df: repo_id, file_path, language, symbol_name, symbol_type, parent_name, signature, parameters, bases, decorators, start_line and end_line.

    df has repo_id, file_path and content; others are not read. Null contents, null paths and other
    languages give no rows; files that do not parse give what can be told; a file that is given twice
    gives its rows twice. An empty table gives no rows.
    """
    text, many = pa.string(), pa.list_(pa.string())
    columns = [("symbol_name", "string", text), ("symbol_type", "string", text), ("parent_name", "string", text), ("signature", "string", text), ("parameters", "array<string>", many), ("bases", "array<string>", many), ("decorators", "array<string>", many), ("start_line", "int", pa.int32()), ("end_line", "int", pa.int32())]
    return _run(df, columns, lambda r: (s[:9] for s in r.symbols))


def imports(df: DataFrame) -> DataFrame:
    """module, imported (a name of it, in Python) and line_no of the imports of each file of df, as for symbols."""
    return _run(df, [("module", "string", pa.string()), ("imported", "string", pa.string()), ("line_no", "int", pa.int32())], lambda r: r.imports())


def calls(df: DataFrame) -> DataFrame:
    """caller (the innermost function around, or null), callee, receiver (what stands before its dot) and line_no of the calls of each file of df, as for symbols."""
    return _run(df, [("caller", "string", pa.string()), ("callee", "string", pa.string()), ("receiver", "string", pa.string()), ("line_no", "int", pa.int32())], lambda r: r.calls())


def inheritance(found: DataFrame) -> DataFrame:
    """repo_id, file_path, symbol_name, base and base_path: the files of a repository, other than its own, that declare a class's base."""
    classes = found.where(~F.col("symbol_type").isin("function", "method"))
    base = F.regexp_extract(F.element_at(F.split("base", r"\."), -1), r"^\W*([\w$]+)", 1)
    each = classes.select("repo_id", "file_path", "symbol_name", F.explode("bases").alias("base")).withColumn("base", base).where("base <> ''").distinct()
    homes = classes.select("repo_id", F.col("symbol_name").alias("base"), F.col("file_path").alias("base_path")).distinct()
    return each.join(homes, ["repo_id", "base"]).where("file_path <> base_path").select("repo_id", "file_path", "symbol_name", "base", "base_path")


def uses(found: DataFrame, imported: DataFrame) -> DataFrame:
    """repo_id, file_path, symbol_name, used and used_path: the classes of a file that may use what the file imports by name from another one of its repository."""
    local = found.where("symbol_type = 'class'").select("repo_id", "file_path", "symbol_name").distinct()
    stem = F.element_at(F.split("module", r"\."), -1)
    names = imported.where("imported is not null and imported <> '*'").select("repo_id", "file_path", F.col("imported").alias("used"), stem.alias("stem")).distinct()
    homes = found.select("repo_id", F.col("symbol_name").alias("used"), F.col("file_path").alias("used_path"), F.regexp_extract("file_path", r"([^/]+)\.[^./]+$", 1).alias("stem")).distinct()
    return local.join(names, ["repo_id", "file_path"]).join(homes, ["repo_id", "used", "stem"]).where("file_path <> used_path").select("repo_id", "file_path", "symbol_name", "used", "used_path").distinct()
