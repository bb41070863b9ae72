"""Problem 6: files that nobody on the team wrote by hand: generated, minified, vendored, or data.

Repositories may declare such paths in attribute files, whose globs are resolved for each attribute by directory and
line; a declaration decides. Elsewhere a file's own text gives evidence: a generator's mark in its
leading comments, lines no hand would write, tables of data, lines of known third-party files. From
files that are declared or have evidence, path patterns are mined (names of directories, parts of
file names) that mark such files all over the corpus, and are applied to the repositories that
declare nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import written

#: Characters of third-party text that are broadcast; more is joined.
BROADCAST = 64_000_000

# Extensions of code, and the marks that generators leave.
CODE = {"py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "java", "kt", "scala", "rb", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "swift", "php", "css", "sh", "lua", "dart", "m", "pl", "r", "jl", "ex", "exs", "zig"}
_MARK = re.compile(
    r"(?i)code generated by|automatically generated|(?<![\w-])auto-?generated(?! method)|@generated|<auto-generated|generated (?:by|from) \S|do not (?:edit|modify)(?! the)\b|edits? (?:are|will be) (?:overwritten|lost)|changes (?:are|will be) (?:lost|overwritten)"
    r"|machine-(?:written|generated)|produced by [\w./-]*(?:gen|codegen|compiler|generator)\b|^\W*[\w./-]+\.(?:idl|proto|thrift|avsc|wsdl|xsd|g4|graphql)\b(?: [0-9a-f]{6,})?\s*$"
)
_RELEASE = re.compile(r"\d+\.\d+")
_LINE_COMMENT = re.compile(r"//|#|--|;|%|<\?(?:php|xml)\b")
#: What opens a comment of several lines, with what closes it.
_OPENING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
#: Lines of a file that no chunk holds are taken for blank as long as no more are missing in a row.
GAP = 12
#: Blanks in the sense of the JVM, for lines that are compared on either side.
_BLANKS = dict.fromkeys(map(ord, " \t\n\x0b\f\r"))
_BLOB = re.compile(r"[A-Za-z0-9+/=]{200,}|(?:-?(?:0[xX][\da-fA-F]+|\d[\d.eE+-]*)[ \t\r\n]*,[ \t\r\n]*){16,}")
_SIMPLE = re.compile(r"[^\W\d]\w*|\d[\w.]*")


def leading(lines: Iterable[str], inside: str = "") -> Iterator[str | None]:
    """The lines of the comments that lines begin with, up to the first line of code; then None, if the comments end before the lines do.

    inside: what closes the comment in which the lines begin.
    """
    for line in lines:
        rest, comment = line.strip(), False
        while rest:
            if inside:
                comment = True
                _, closed, rest = rest.partition(inside)
                rest = rest.strip()
                inside = "" if closed else inside
                if not closed:
                    break
            elif opening := next((o for o in _OPENING if rest.startswith(o)), None):
                inside, rest, comment = _OPENING[opening], rest[len(opening) :], True
                if not rest:
                    break
            elif _LINE_COMMENT.match(rest):
                comment = True
                break
            else:
                if comment:
                    yield line[: line.rfind(rest)]
                yield None
                return
        yield line


def header(lines: Iterable[str], path: str) -> tuple[bool, bool, bool]:
    """Whether the comments that lines begin with have a generator's mark, name a release of what the path is named after, and go on to the end."""
    marked = licensed = False
    parts = re.split(r"[/_.]", path.lower())
    for line in leading(lines):
        if line is None:
            return marked, licensed, False
        marked = marked or bool(_MARK.search(line))
        if not licensed and _RELEASE.search(line):
            licensed = any(w in parts for w in re.findall(r"[a-z]\w{2,}(?:-[a-z]\w*)*", line.lower()))
    return marked, licensed, True


def _features(text: str, path: str, known: set[int] | None) -> tuple:
    """marked, licensed, open, chars, chars in long lines, chars of data, lines, lines of the commonest shape, telling lines, of these known ones."""
    lines = text.replace("\r\n", "\n").split("\n")
    marked, licensed, on = header(lines, path)
    code = path.rsplit(".", 1)[-1].lower() in CODE
    full = [x for x in lines if x.strip()]
    shapes = Counter(_SIMPLE.sub(lambda t: "9" if t[0][0].isdigit() else "w", x.strip()) for x in full) if code else Counter()
    common = max((n for s, n in shapes.items() if "9" in s), default=0)
    telling = matched = 0
    for x in full:
        squeezed = x.translate(_BLANKS)
        if len(squeezed) > 25:
            telling += 1
            if known is not None and xxhash.xxh64_intdigest(squeezed) in known:
                matched += 1
    return (
        marked, licensed, on, len(text), sum(len(x) for x in full if len(x) > 300) if code else 0, sum(len(m) for m in _BLOB.findall(text)) if code else 0, len(full), common, telling, matched,
    )


SCHEMA = "repo_id string, file_path string, start_line int, marked boolean, licensed boolean, on boolean, chars bigint, long bigint, data bigint, lines bigint, common bigint, telling bigint, known bigint"


def evidence(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """repo_id, file_path and evidence, whether a file's own text shows that it was not written by hand."""
    spark = chunks.sparkSession
    size = upstream.agg(F.sum(F.length("content"))).first()[0] or 0
    lines = upstream.where("content is not null").select(F.explode(F.split("content", "\n")).alias("line")).select(F.regexp_replace("line", r"\s+", "").alias("line")).where(F.length("line") > 25).select(F.xxhash64("line").alias("h"), "line").distinct()
    small = size <= BROADCAST
    shared = spark.sparkContext.broadcast([x for x in lines.select("line").toArrow().column(0).to_pylist()] if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {xxhash.xxh64_intdigest(x) for x in shared.value} if shared.value is not None else None
        types = [pa.bool_()] * 3 + [pa.int64()] * 7
        for b in batches:
            rows = [_features(t, p or "", known) for p, t in zip(*[c.to_pylist() for c in b.columns[1:3]], strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["repo_id", "file_path", "start_line", "marked", "licensed", "on", "chars", "long", "data", "lines", "common", "telling", "known"])

    file = ["repo_id", "file_path"]
    rows = chunks.where("chunk_text is not null and repo_id is not null and file_path is not null").select(*file, "chunk_text", F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"))
    heads = F.min_by(F.struct("marked", "licensed", "on"), F.struct("start_line", F.col("on"), ~F.col("marked"), ~F.col("licensed")))
    of = written(rows.mapInArrow(run, SCHEMA).groupBy(*file).agg(heads.alias("head"), F.min("start_line").alias("first"), *[F.sum(c).alias(c) for c in ("chars", "long", "data", "lines", "common", "telling", "known")]))
    at_start = F.col("first") <= GAP + 1

    def through(key: tuple, t: pa.Table) -> pa.Table:
        """A header that fills its file's first chunk goes on in the next."""
        chunks: dict[int, str] = {}
        for n, text in sorted(zip(t.column("start_line").to_pylist(), t.column("chunk_text").to_pylist(), strict=True)):
            chunks.setdefault(n, text)

        def lines() -> Iterator[str]:
            at = 1
            for n, text in chunks.items():
                if n > at + GAP:
                    yield "unknown"
                    return
                here = text.replace("\r\n", "\n").split("\n")
                at = max(at, n + len(here))
                yield from here

        marked, licensed, _ = header(lines(), key[1].as_py())
        return pa.table({"repo_id": pa.array([key[0].as_py()], pa.string()), "file_path": pa.array([key[1].as_py()], pa.string()), "marked": [marked], "licensed": [licensed]})

    going_on = written(of.where(at_start & F.col("head.on")).select(*file))  # few: with their size known, they are broadcast
    whole = rows.join(going_on, file, "left_semi").groupBy(*file).applyInArrow(through, "repo_id string, file_path string, marked boolean, licensed boolean")
    of = of.join(whole, file, "left").withColumn("marked", at_start & F.coalesce("marked", "head.marked")).withColumn("licensed", at_start & F.coalesce("licensed", "head.licensed"))
    if not small:
        mine = rows.select("repo_id", "file_path", F.explode(F.split("chunk_text", "\n")).alias("line")).select("repo_id", "file_path", F.regexp_replace("line", r"\s+", "").alias("line")).where(F.length("line") > 25)
        hit = mine.join(lines.select("line"), "line", "left_semi").groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("known"))
        of = of.drop("known").join(hit, ["repo_id", "file_path"], "left").fillna(0, ["known"])
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    shown = F.col("marked") | F.col("licensed") | (share("long", "chars") >= 0.5) | (share("data", "chars") >= 0.5) | ((F.col("lines") >= 8) & (share("common", "lines") >= 0.6)) | ((F.col("telling") >= 3) & (share("known", "telling") >= 0.6))
    return of.select("repo_id", "file_path", shown.alias("evidence"))


# --------------------------------------------------------------------------- attribute files


def glob(pattern: str) -> str:
    """The regular expression of an attribute file's pattern, for paths relative to its directory."""
    anchored = "/" in pattern.strip("/")
    out, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and (i == 0 or p[i - 1] == "/"):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            out, i = out + "[" + ("^" + p[i + 2 : end] if p[i + 1] in "!^" else p[i + 1 : end]).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored or pattern.startswith("/") else "(?:.*/)?") + out + ("/.*" if pattern.endswith("/") else "")


_ATTRIBUTE = re.compile(r"([-!])?linguist-(generated|vendored)(?:=(\S+))?")
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"\s+(.*)")


def rules(text: str, first: int = 1) -> list[tuple[int, str, str, bool | None]]:
    """Of a part of an attribute file that begins at line first: line, pattern, attribute, and whether it is set, unset (False) or left open again (None)."""
    out: list[tuple[int, str, str, bool | None]] = []
    for n, line in enumerate(text.split("\n"), first):
        line = line.strip()
        if not line or line[0] in "#!" or line.startswith("[attr]"):
            continue
        if quoted := _QUOTED.fullmatch(line):
            pattern, rest = re.sub(r"\\(.)", r"\1", quoted[1]), quoted[2]
        else:
            pattern, _, rest = line.replace("\t", " ").partition(" ")
        for word in rest.split():
            if m := _ATTRIBUTE.fullmatch(word):
                value = None if m[1] == "!" else False if m[1] == "-" else (m[3] or "true").lower() in ("true", "1", "yes", "set")
                out.append((n, pattern, m[2], value))
    return out


class Declarations:
    """The rules of a repository's attribute files. Of each attribute the last rule that matches counts: in its file by line, and of a deeper directory before those above."""

    def __init__(self, said: list[tuple[str, int, str, str, bool | None]]):
        self.of: dict[str, list[tuple[re.Pattern[str], str, bool | None]]] = {}
        for directory, _, pattern, attribute, value in sorted(set(said), key=lambda r: (r[0], r[1], r[2], r[3], str(r[4]))):
            self.of.setdefault(directory, []).append((re.compile(glob(pattern), re.S), attribute, value))

    def __call__(self, path: str) -> bool | None:
        """Whether a file is declared not to be written by hand: by any attribute that is set; False if one is unset and none set."""
        values: dict[str, bool | None] = {}
        parts = path.split("/")
        for depth in range(len(parts)):
            inside = "/".join(parts[depth:])
            for regex, attribute, value in self.of.get("/".join(parts[:depth]), ()):
                if regex.fullmatch(inside):
                    values[attribute] = value
        given = [v for v in values.values() if v is not None]
        return any(given) if given else None


#: Files of a repository that one task compares with its rules.
SLICE = 100_000


def declared(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, file_path and declared: what the attribute files of its repository say of a file, of which all chunks are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r, p.rpartition("/")[0], *x) for r, p, t, n in zip(*[c.to_pylist() for c in b.columns], strict=True) for x in rules(t, n)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["repo_id", "dir", "line", "pattern", "attribute", "says"])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        says = Declarations(list(zip(*[right.column(c).to_pylist() for c in ("dir", "line", "pattern", "attribute", "says")], strict=True)))
        paths = left.column("file_path").to_pylist() if len(right) else []
        return pa.table({"repo_id": left.column("repo_id").slice(0, len(paths)), "file_path": pa.array(paths, pa.string()), "declared": pa.array([says(p) for p in paths], pa.bool_())})

    there = chunks.where(F.col("file_path").rlike(r"(^|/)\.gitattributes$") & F.col("chunk_text").isNotNull()).select("repo_id", "file_path", "chunk_text", F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"))
    said = written(there.mapInArrow(read, "repo_id string, dir string, line int, pattern string, attribute string, says boolean").distinct())
    mine = files.select("repo_id", "file_path").join(said.select("repo_id").distinct(), "repo_id", "left_semi")
    # the files of a repository are dealt out to slices, each of which gets the repository's rules
    slices = mine.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    rows = mine.join(slices, "repo_id").select("repo_id", "file_path", F.pmod(F.xxhash64("file_path"), F.col("slices")).cast("int").alias("slice"))
    spread = said.join(slices.alias("s"), "repo_id").select("repo_id", "dir", "line", "pattern", "attribute", "says", F.explode(F.sequence(F.lit(0), F.col("s.slices") - 1)).alias("slice"))
    return rows.groupBy("repo_id", "slice").cogroup(spread.groupBy("repo_id", "slice")).applyInArrow(apply, "repo_id string, file_path string, declared boolean").where("declared is not null")


# --------------------------------------------------------------------------- mined patterns


def patterns(path: Column) -> Column:
    """What of a path may mark it: the names of its directories, and the parts of its file name with their places."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    bits = F.split(F.regexp_replace(name, r"[0-9a-f]{8,}", "#"), r"[._-]")
    dirs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: F.concat(F.lit("dir:"), d))
    n = F.size(bits)
    last = F.when(n > 2, F.array(F.concat(F.lit("last:"), F.element_at(F.slice(bits, 1, F.greatest(n - 1, F.lit(1))), -1)))).otherwise(F.array().cast("array<string>"))
    start = F.when(n > 2, F.array(F.concat(F.lit("first:"), bits[0]))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(dirs, last, start))


def classify(chunks: DataFrame, upstream: DataFrame, sure: float = 0.5) -> DataFrame:
    """repo_id, file_path and by_hand, whether the file was written by hand on the repository's team.

    chunks has repo_id, file_path, chunk_text and start_line, upstream content; others are not read.
    A null in repo_id or file_path is no file; a file all of whose texts are null has no evidence and
    is judged by its path; empty texts are no evidence; repeated chunks count once more each, alike for
    every share. Without upstream, attribute files or any file the results are what the rest gives.
    sure: a pattern counts if the lower bound (95 %, one-sided) of the share of its file names that are
    known not to be written by hand is above this.
    """
    files = chunks.where("repo_id is not null and file_path is not null").select("repo_id", "file_path").distinct()
    of = files.join(evidence(chunks, upstream), ["repo_id", "file_path"], "left").join(declared(chunks, files), ["repo_id", "file_path"], "left")
    known = written(of.select("repo_id", "file_path", F.coalesce("declared", "evidence", F.lit(False)).alias("known"), "declared"))
    marks = known.select("repo_id", "file_path", "known", F.explode(patterns(F.col("file_path"))).alias("pattern"))
    # files of one name count as one: copies of a library's file make no pattern of its name
    names = marks.groupBy("pattern", F.element_at(F.split("file_path", "/"), -1).alias("name")).agg(F.avg(F.col("known").cast("int")).alias("k"))
    counts = names.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    z = 1.645
    p = F.col("k") / F.col("n")
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    mined = counts.where(bound > sure).select("pattern")
    by_path = marks.join(mined, "pattern", "left_semi").select("repo_id", "file_path").distinct().withColumn("mined", F.lit(True))
    out = known.join(by_path, ["repo_id", "file_path"], "left")
    return out.select("repo_id", "file_path", (~F.coalesce("declared", F.col("known") | F.coalesce("mined", F.lit(False)))).alias("by_hand"))
