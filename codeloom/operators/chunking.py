"""Cutting files into chunks, packing texts into batches and budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "chunk_no int, chunk_text string, chunk_hash string, start_line int, end_line int, start_char int"


def windows(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of size characters, each beginning size - overlap after the one before, with position and hash; other columns are kept."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = df.where(F.length(text) > 0).withColumn("at", F.explode(starts))
    part = F.substring(F.col(text), F.col("at") + 1, F.lit(size))
    return cut.select(*[c for c in df.columns if c != text], (F.col("at") / step).cast("int").alias("chunk_no"), part.alias("chunk_text"), F.substring(F.sha2(part, 256), 1, 16).alias("chunk_hash"))


def _lines_of(content: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 line of each chunk that is filled until it has size characters."""
    lines = content.split("\n")
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and chars < size:
            chars += len(lines[end]) + 1
            end += 1
        yield at, end
        back = max(1, int(overlap / size * (end - at)))
        at = end if end - back <= at else end - back  # a chunk always ends beyond its first line


def _chars_of(content: str, most: int, fewest: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most so many characters, each stepping back three lines."""
    lines = content.split("\n")
    at = 0
    while at < len(lines):
        end, chars = at + 1, len(lines[at])
        while end < len(lines) and chars + len(lines[end]) + 1 <= most:
            chars += len(lines[end]) + 1
            end += 1
        if len("\n".join(lines[at:end]).strip()) >= fewest:
            yield at, end
        at = max(at + 1, end - 3) if end < len(lines) else end


def _chunks(df: DataFrame, keys: Sequence[str], text: str, cut: Callable[[str], Iterator[tuple[int, int]]]) -> DataFrame:
    types = df.select(*keys).schema
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []
            for row, content in enumerate(b.column(n).to_pylist()):
                lines = content.split("\n")
                starts = [0]
                for x in lines:
                    starts.append(starts[-1] + len(x) + 1)
                for i, (low, high) in enumerate(cut(content)):
                    part = "\n".join(lines[low:high])
                    at.append(row)
                    out.append((i, part, hashlib.sha256(part.encode()).hexdigest()[:16], low + 1, high, starts[low]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(n)], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [*keys, "chunk_no", "chunk_text", "chunk_hash", "start_line", "end_line", "start_char"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types) + ", " + CHUNK
    return df.where(F.length(text) > 0).select(*keys, text).mapInArrow(run, schema)


def line_chunks(df: DataFrame, keys: Sequence[str], text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """Chunks of whole lines that reach size characters, overlapping by the share of lines that overlap is of size; null and empty texts give none."""
    return _chunks(df, keys, text, lambda c: _lines_of(c, size, overlap))


def char_chunks(df: DataFrame, keys: Sequence[str], text: str, most: int = 2048, fewest: int = 50) -> DataFrame:
    """Chunks of whole lines of at most most characters with three lines of overlap, those of fewer than fewest left out; a longer line is a chunk."""
    return _chunks(df, keys, text, lambda c: _chars_of(c, most, fewest))


def symbol_chunks(files: DataFrame, symbols: DataFrame, most: int = 2048, fewest: int = 50) -> DataFrame:
    """One chunk for each symbol of a file with a header that names file, owner, kind and language, and one for each range of lines no symbol covers.

    files has repo_id, file_path, content; symbols repo_id, file_path, symbol_name, symbol_type,
    start_line, end_line and parent_name, nulls allowed. The header is put before texts that stay within most with it.
    """
    key = ["repo_id", "file_path"]
    lines = files.select(*key, "language", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    spans = symbols.where("start_line >= 1 and end_line >= start_line").select(*key, "symbol_name", "symbol_type", "parent_name", "start_line", "end_line").distinct()
    inside = lines.join(spans, key).where(F.col("pos") + 1 >= F.col("start_line")).where(F.col("pos") + 1 <= F.col("end_line"))
    text = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    own = inside.groupBy(*key, "language", "symbol_name", "symbol_type", "parent_name", "start_line", "end_line").agg(text().alias("text"))
    free = uncovered(lines.select(*key, "language", (F.col("pos") + 1).alias("line_no"), "line"), spans, key)
    rest = free.select(*key, "language", F.lit(None).cast("string").alias("symbol_name"), F.lit("module").alias("symbol_type"), F.lit(None).cast("string").alias("parent_name"), "start_line", "end_line", "text")
    header = F.concat_ws("\n", F.concat(F.lit("# File: "), "file_path"), F.concat(F.lit("# Class: "), "parent_name"), F.concat(F.lit("# Kind: "), "symbol_type"), F.concat(F.lit("# Language: "), "language"))
    whole = F.concat_ws("\n", header, "text")
    all_ = own.unionByName(rest).where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= fewest)
    return all_.select(*key, "symbol_name", "symbol_type", "start_line", "end_line", F.substring(F.sha2("text", 256), 1, 16).alias("chunk_hash"), F.when(F.length(whole) <= most, whole).otherwise(F.col("text")).alias("chunk_text"))


def gaps(files: DataFrame, text: str, spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, start_line, end_line and text of the ranges of lines of each file that no span covers.

    A file stays one row: its spans, in order, are folded into the ranges between them, and these
    are cut from its lines. A null text has no lines; files of one key are taken each for itself.
    """
    span = F.struct(F.col("start_line").cast("int").alias("a"), F.col("end_line").cast("int").alias("z"))
    of = spans.groupBy(*key).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    lines = F.split(text, "\n")
    n = F.size("lines")
    rows = files.where(F.col(text).isNotNull()).join(of, list(key), "left").select(*key, lines.alias("lines"), F.coalesce("spans", F.array().cast("array<struct<a:int,z:int>>")).alias("spans"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<a:int,z:int>>").alias("free"))
    between = lambda acc, x: F.array(F.struct(acc["next"].alias("a"), F.least(x["a"] - 1, n).alias("z")))

    def step(acc, x):  # type: ignore[no-untyped-def]
        free = F.when((x["a"] > acc["next"]) & (acc["next"] <= n), F.concat(acc["free"], between(acc, x))).otherwise(acc["free"])
        return F.struct(F.greatest(acc["next"], x["z"] + 1).alias("next"), free.alias("free"))

    done = F.aggregate(F.concat("spans", F.array(F.struct((n + 1).alias("a"), n.alias("z")))), start, step)
    free = rows.select(*key, "lines", F.explode(done["free"]).alias("r"))
    return free.select(*key, F.col("r.a").alias("start_line"), F.col("r.z").alias("end_line"), F.array_join(F.slice("lines", F.col("r.a"), F.col("r.z") - F.col("r.a") + 1), "\n").alias("text"))


def uncovered(lines: DataFrame, spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ranges of lines (key, line_no, line and others) that no span covers, with their text: gaps and islands."""
    covered = lines.join(spans.select(*key, "start_line", "end_line"), list(key)).where("line_no between start_line and end_line").select(*key, "line_no").distinct()
    free = lines.join(covered, [*key, "line_no"], "left_anti")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))
    rest = [c for c in lines.columns if c not in (*key, "line_no", "line")]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    return free.withColumn("island", island).groupBy(*key, *rest, "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), joined.alias("text")).drop("island")


def batches_of(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """batch_no: rows of each group in order, so many to a batch."""
    return df.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("bigint"))


def token_batches(df: DataFrame, by: str, order: str, tokens: str, items: int = 250, most: int = 20_000, overlap: bool = False) -> DataFrame:
    """by, order, tokens and batch_no: rows of each group in order, a new batch when items or tokens would be exceeded.

    overlap: a batch begins with the last row of the one before it. A row that alone exceeds most is a
    batch of its own. The choice depends on all rows before, so that each group is one stream of rows.
    """
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, {tokens} bigint, batch_no bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group and order; only the state of the open batch is kept
        group, n, total, no, last = object(), 0, 0, -1, None
        for b in batches:
            rows: list[int] = []
            sizes: list[int] = []
            nos: list[int] = []
            again: list[tuple] = []
            for i, (g, o, t) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)):
                if g != group:
                    group, n, total, no, last = g, 0, 0, 0, None
                elif n and (n >= items or total + t > most):
                    no, n, total = no + 1, 0, 0
                    if overlap and last is not None and last[2] + t <= most:
                        again.append((g, last[1], last[2], no))
                        n, total = 1, last[2]
                rows.append(i)
                sizes.append(t)
                nos.append(no)
                n, total, last = n + 1, total + t, (g, o, t)
            names = [by, order, tokens, "batch_no"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(nos, pa.int64())], names)
            if again:
                cols = list(zip(*again, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], b.column(1).type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names)

    ordered = df.select(by, order, F.col(tokens).cast("bigint").alias(tokens)).repartition(by).sortWithinPartitions(by, order)
    return ordered.mapInArrow(run, schema)


def within_budget(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], length: str, budget: int, least: int = 100) -> DataFrame:
    """running and taken: how much of each row, in order, fits the budget of its group.

    Rows fit whole until the first that does not; of that one what is left is taken if it is more than
    least; the rest are left out.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.withColumn("running", F.sum(length).over(w))
    before = F.col("running") - F.col(length)
    taken = F.when(F.col("running") <= budget, F.col(length)).when((before <= budget) & (budget - before > least), budget - before)
    return run.withColumn("taken", taken).where("taken is not null")


def outline(symbols: DataFrame) -> DataFrame:
    """repo_id, file_path and outline: the symbols of a file in their order, one to a line."""
    line = F.concat(F.lit("L"), F.col("start_line").cast("string"), F.lit(" "), F.coalesce("symbol_type", F.lit("symbol")), F.lit(" "), "symbol_name")
    one = symbols.where("symbol_name is not null").groupBy("repo_id", "file_path", "start_line", "symbol_type", "symbol_name").agg(F.lit(1).alias("one"))
    return one.groupBy("repo_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbol_name", line.alias("line")))), lambda x: x.line), "\n").alias("outline"))


def joined(chunks: DataFrame, by: Sequence[str] = ("repo_id", "file_path")) -> DataFrame:
    """by and text: the different chunks of each file in the order of their lines, joined by line ends; null texts are left out."""
    one = chunks.where("chunk_text is not null").groupBy(*by, "start_line", "end_line", "chunk_text").agg(F.lit(1).alias("one"))
    parts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chunk_text")))
    return one.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x.chunk_text), "\n").alias("text"))
