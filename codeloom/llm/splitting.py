"""Problem 3: splitting long texts at natural boundaries.

Every place where a text may be cut has a strength: the start of a symbol or of a block after a
blank line is stronger than a line end, and inside a line a space is stronger than any other
place. A sparse table over the strengths answers which cut is the strongest within the window of
permissible lengths, the rightmost of equals; the next piece starts an overlap before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"[^\n]*\n|[^\n]+")
# First words of lines that begin a symbol.
SYMBOL = re.compile(r"\s*(?:@|(?:(?:export|default|public|private|protected|static|final|abstract|async)\s+)*(?:def|class|func|function|interface|struct|type|enum|impl|fn|module|namespace|variable|resource)\b|#{1,6} )")

SCHEMA = "row_id bigint, piece int, chunk_text string, start_line int, end_line int, cut_line int, start_char int"


class RangeMax:
    """Sparse table: the position of the greatest value in a range, the rightmost of equals."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.rows = [np.arange(len(values))]
        k = 1
        while 2 * k <= len(values):
            a, b = self.rows[-1][: len(values) - 2 * k + 1], self.rows[-1][k : len(values) - k + 1]
            self.rows.append(np.where(values[b] >= values[a], b, a))
            k *= 2

    def query(self, low: int, high: int) -> int:
        """Over low to high, both included."""
        j = (high - low + 1).bit_length() - 1
        a, b = int(self.rows[j][low]), int(self.rows[j][high - (1 << j) + 1])
        return b if self.values[b] >= self.values[a] else a


def pieces(text: str, limit: int = 2048, overlap_lines: int = 2, overlap_chars: int = 128) -> Iterator[tuple[int, int, int, int, int]]:
    """Start and end of each piece in characters, its first and last line (from 1), and the line its end cuts, or 0."""
    ends = np.fromiter((m.end() for m in LINE.finditer(text)), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    lines = LINE.findall(text)
    n = len(text)
    at, strength, inside = [], [], []
    for i, line in enumerate(lines):
        body = line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith("\n") else line
        if len(body) > limit:
            for c in range(1, len(body)):
                at.append(int(starts[i]) + c)
                strength.append(1 if body[c - 1] in " \t,;" else 0)
                inside.append(i + 1)
        elif len(line) > limit:  # only its end doesn't fit: it may be cut before that, which cuts no line
            at.append(int(starts[i]) + len(body))
            strength.append(1)
            inside.append(0)
        after = lines[i + 1] if i + 1 < len(lines) else ""
        at.append(int(ends[i]))
        inside.append(0)
        if not line.strip():
            strength.append(5 if SYMBOL.match(after) and not after[:1].isspace() else 4)
        elif SYMBOL.match(after):
            strength.append(4 if not after[:1].isspace() else 3)
        else:
            strength.append(3 if not after.strip() else 2)
    places, table = np.array(at), RangeMax(np.array(strength))
    start = cut = 0
    while n - start > limit:
        low = int(np.searchsorted(places, max(start + limit // 2, cut + 1)))
        high = int(np.searchsorted(places, start + limit, side="right")) - 1
        if low > high:  # long lines leave no cut in the upper half of the window
            low = int(np.searchsorted(places, cut + 1))
        if low > high:  # nor any beyond the last cut: the overlap must shrink
            back = int(np.searchsorted(starts, start, side="right"))
            start = min(int(starts[back]), cut) if back < len(starts) and starts[back] > start else cut
            continue
        k = table.query(low, high)
        cut = int(places[k])
        line_of = int(np.searchsorted(ends, start, side="right"))
        yield start, cut, line_of + 1, int(np.searchsorted(ends, cut, side="left")) + 1, inside[k]
        if inside[k]:
            start = max(start + 1, cut - overlap_chars)
        else:
            last = int(np.searchsorted(ends, cut, side="left"))
            for k in range(min(overlap_lines, last + 1), 0, -1):  # fewer lines where they would be the whole piece
                back = int(starts[last - k + 1])
                if max(ends[last - k + 1 : last + 1] - starts[last - k + 1 : last + 1]) > limit:
                    back = cut - overlap_chars
                if back > start:
                    break
            start = back if back > start else cut
    yield start, n, int(np.searchsorted(ends, start, side="right")) + 1, len(lines), 0


def split(df: DataFrame, limit: int = 2048, overlap_lines: int = 2, overlap_chars: int = 128) -> DataFrame:
    """row_id, piece (from 1), chunk_text, start_line, end_line, cut_line and start_char of the pieces of each row's chunk_text.

    df has row_id, chunk_text and start_line; others are not read. No piece is longer than limit.
    start_line and end_line are lines of the file; cut_line is the line, counted inside the chunk,
    that had to be cut at the piece's end, else 0; start_char is the offset of the piece in the text.
    The overlap has fewer lines where as many would make up the whole piece. Shorter texts are one piece and stay in the JVM.
    A null text gives no rows, the empty text one empty piece; a null start_line counts as 1, and
    repeated rows are split each for itself.
    """
    rows = df.select(F.col("row_id").cast("bigint"), "chunk_text", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"))
    short = rows.where(F.length("chunk_text") <= limit).select(
        "row_id", F.lit(1).alias("piece"), "chunk_text", "start_line", (F.col("start_line") + F.greatest(F.size(F.split("chunk_text", "\n")) - F.when(F.col("chunk_text").endswith("\n"), 2).otherwise(1), F.lit(0))).alias("end_line"), F.lit(0).alias("cut_line"), F.lit(0).alias("start_char")
    )
    return split_long(df, limit, overlap_lines, overlap_chars).unionByName(short)


def split_long(df: DataFrame, limit: int = 2048, overlap_lines: int = 2, overlap_chars: int = 128) -> DataFrame:
    """As split, of the rows whose text is longer than limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for row, text, line in zip(*[c.to_pylist() for c in b.slice(k, 256).columns], strict=True):
                    for i, (s, e, first, last, cut) in enumerate(pieces(text, limit, overlap_lines, overlap_chars), 1):
                        out.append((row, i, text[s:e], line + first - 1, line + last - 1, cut, s))
                cols = list(zip(*out, strict=True)) or [[]] * 7
                types = [pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["row_id", "piece", "chunk_text", "start_line", "end_line", "cut_line", "start_char"])

    rows = df.where(F.length("chunk_text") > limit).select(F.col("row_id").cast("bigint"), "chunk_text", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"))
    return rows.mapInArrow(run, SCHEMA)
