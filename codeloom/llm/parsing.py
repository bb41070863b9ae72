"""Problem 7: source files that do not parse.

Each file is read by the dialects of its extension's language (scripts and modules of JavaScript and
TypeScript, ordinary and modular files of Java; Go, JSON and Python 3 have one), run together by a generalised LL
recogniser (gll.py, grammars.py); a file is flagged if every dialect rejects it. Tasks work on
whole files as the scan gives them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import grammars as G
from codeloom.functions import lexing

T = TypeVar("T")

# The language of each extension that is checked.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json"}
SCHEMA = "repo_id string, file_path string, success boolean, error string, language string"

_languages: dict[str, G.Language] = {}


def language(name: str) -> G.Language:
    """The recogniser of a language, made once in a Python worker."""
    if name not in _languages:
        _languages[name] = {
            "python": G.Python,
            "javascript": lambda: G.Language(lambda t: lexing.script(t).tokens, G._script(False), True),
            "typescript": lambda: G.Language(lambda t: lexing.script(t).tokens, G._script(True), True),
            "go": lambda: G.Language(lexing.go_tokens, G._go()),
            "java": lambda: G.Language(lexing.java_tokens, G._java()),
            "json": lambda: G.Language(lexing.json_tokens, G._json()),
        }[name]()
    return _languages[name]


def fault(content: str, lang: str) -> str | None:
    """Why content isn't a file of lang, or None if it is."""
    return None if language(lang).accepts(content, None) else f"rejected by every dialect of {lang}"


class Verdicts(Generic[T]):
    """What a function of a text and its language gives, kept by the text's digest so that copies are worked out once."""

    def __init__(self, of: Callable[[str, str], T], kept: int = 20_000):
        self.of, self.kept = of, kept
        self.known: dict[tuple[str, bytes], T] = {}

    def __call__(self, content: str, lang: str) -> T:
        key = (lang, xxhash.xxh3_128_digest(content.encode("utf-8", "surrogatepass")))
        if key not in self.known:
            if len(self.known) >= self.kept:
                self.known.clear()
            self.known[key] = self.of(content, lang)
        return self.known[key]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def check(df: DataFrame) -> DataFrame:
    """repo_id, file_path, success, error and language of each row of df that has repo_id, file_path and content.

    success is null where nothing can be judged: for null content and other extensions (a null
    file_path is one). The empty file is judged as its language says: valid for Python, JavaScript,
    TypeScript and Java, not for Go and JSON. Repeated rows are judged each for itself; further
    columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Verdicts[str | None] = Verdicts(fault)
        for b in batches:
            error = [known(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            errors = pa.array(error, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), errors.is_null(), errors, b.column(3)], ["repo_id", "file_path", "success", "error", "language"])

    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(F.col("file_path")))
    rows = df.select("repo_id", "file_path", "content", F.when(F.col("content").isNotNull(), lang).alias("lang"))
    judged = rows.where("lang is not null").mapInArrow(run, SCHEMA)
    rest = rows.where("lang is null").select("repo_id", "file_path", F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("string").alias("error"), lang.alias("language"))
    return judged.unionByName(rest)


def found(df: DataFrame) -> DataFrame:
    """The distinct repo_id and file_path of the files that are rejected."""
    return check(df).where("not success").select("repo_id", "file_path").distinct()


def rates(df: DataFrame) -> DataFrame:
    """Files judged, rejected, and the share rejected, per repo_id and language; a file scanned twice counts once."""
    once = check(df).where("success is not null").groupBy("repo_id", "language", "file_path").agg(F.min("success").alias("success"))
    return once.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("success")).alias("n_rejected"), F.round(F.count_if(~F.col("success")) / F.count(F.lit(1)), 6).alias("rate")
    )
