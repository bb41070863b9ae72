"""Problem 8: encoding with a public byte-level BPE vocabulary.

The encoder backtracks over longest matches. An Aho-Corasick automaton gives the longest token at
each byte of a word; a token may follow another only if byte-pair merging would keep the boundary
between them, which is looked up in a table of pairs that is filled as pairs occur. That gives the
ids of the merge procedure without merging, in time linear in the word. Decoding reads the bytes
of a token through a table of offsets.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import TOKENIZERS

# Fixed value: the pattern by which this vocabulary's texts are split into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII characters only, for which the standard library's engine is faster.
ASCII_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Words whose ids are kept by a worker; the table starts anew when it is full.
CACHED_WORDS = 400_000


class Encoder:
    def __init__(self, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.blob = b"".join(self.bytes)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        self.halves = [(i, i) for i in range(size)]
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i, b in enumerate(self.bytes):  # in the order of the merges, so that parts come before wholes
            for k in range(len(b) - 1, 0, -1):
                if (p := ranks.get(b[:k])) is not None:
                    self.shorter[i] = p
                    break
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k], size), ranks.get(b[k:], size)
                if left < i and right < i and self._keeps(left, right):
                    self.halves[i] = (left, right)
                    self.joined[left, right] = i
                    break
        self.cache: dict[str, list[int]] = {}
        self.words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS).findall

    def _keeps(self, left: int, right: int) -> bool:
        """Whether merging keeps the boundary between two tokens that stand side by side.

        The last merges are undone on either side, the later one first; the boundary falls if the
        tokens that then meet at it merge sooner than what was undone.
        """
        limit = len(self.bytes)
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                inner = self.halves[left][1]
                if inner == left:
                    limit, inner = right + 1, self.halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    limit, left = left, inner
            else:
                inner = self.halves[right][0]
                if inner == right:
                    limit, inner = left, self.halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    limit, right = right + 1, inner

    def _fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._keeps(left, right)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest, length = [-1] * n, [0] * n
        for end, (k, i) in self.automaton.iter(word.decode("latin-1")):
            if k > length[end - k + 1]:
                length[end - k + 1], longest[end - k + 1] = k, i
        alive = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + len(self.bytes[token])
                if alive[end] and (last < 0 or self._fit(last, token)):
                    out.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    alive[at] = 0
                    if last < 0:
                        raise ValueError("no encoding")
                    token = out.pop()
                    at -= len(self.bytes[token])
                    break
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and for the empty text."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for w in self.ascii_words(text) if text.isascii() else self.words(text):
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                ids = self.encode_word(w.encode())
                if len(w) <= 64:
                    cache[w] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        o = self.offsets
        return b"".join(self.blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, key: Column, text: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and ids of every row of df, in one narrow stage without a shuffle.

    key and text are columns of df, whatever other columns it has. Null and empty texts give an
    empty list, a null key stays null, repeated rows are encoded each for itself; there is no limit
    of length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 512):  # ids take several times the room of the text
                part = b.slice(k, 512)
                ids = pa.array([e.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return df.select(key.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """df with the column text decoded from ids; null for null ids, empty for none."""

    @F.pandas_udf("string")
    def run(s):  # type: ignore[no-untyped-def]
        e = encoder(path)
        return s.map(lambda x: None if x is None else e.decode(x))

    return df.withColumn("text", run(F.col(ids)))
