"""Problem 4: near-duplicate texts, by MinHash with Bayesian pruning of candidates.

Texts that agree in a band of MinHash values are candidates. The values of a candidate pair are
compared step by step; the pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance, and what is left is verified exactly. Buckets are
compared in blocks of bounded size, and a pair is taken up only in the first band in which it
agrees, so that neither a large bucket nor a pair of many bands is gathered anywhere. Only numbers
are shuffled to the buckets; signatures follow to the buckets that have several members.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.base import written

BANDS, ROWS = 24, 4
#: Members of a bucket that are compared in one task with as many others.
BLOCK = 1024
WORDS = re.compile(r"\w+")

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingles:
    """Hashes of the runs of words of a text."""

    def __init__(self, run: int):
        self.run = run
        self.words: dict[str, int] = {}

    def of(self, text: str, least: int) -> np.ndarray | None:
        """Sorted and distinct; None for a text of fewer than least words."""
        words = WORDS.findall(text.lower())
        n = len(words) - self.run + 1
        if len(words) < least or n < 1:
            return None
        if len(self.words) > 500_000:
            self.words.clear()
        known = self.words
        try:
            codes = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            codes = [known[w] for w in words]
        h = np.array(codes, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(self.run):
            out = (out ^ h[k : k + n]) * _MIX[k % 3]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """The lower 16 bits of each set's least values, one row for each set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint16)
    for k in range(0, len(sets), 64):
        part = sets[k : k + 64]
        x = np.concatenate(part)
        at = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((x * _A[i] + _B[i]) >> np.uint64(32), at)
            out[k : k + 64, i] = least.astype(np.uint16)  # the lower bits
    return out


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Matches among n values below which a similarity of threshold is less probable than tolerance.

    With a uniform prior the posterior is a beta distribution, whose upper tail is the lower tail of a binomial one.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def signatures(df: DataFrame, run: int, least: int) -> DataFrame:
    """id, sig and the shingles of the chunk_hash of df; a chunk_hash has at most one row of each task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(run), set()
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                ids, sets = [], []
                for i, t in zip(*[c.to_pylist() for c in b.slice(k, 1024).columns], strict=True):
                    digest = xxhash.xxh3_128_digest(i)
                    if digest in seen:
                        continue
                    seen.add(digest)
                    if (s := shingles.of(t, least)) is not None:
                        ids.append(i)
                        sets.append(s)
                sig = minhash(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "sig", "shingles"]
                )

    texts = df.where("chunk_hash is not null and chunk_text is not null").select("chunk_hash", "chunk_text")
    return texts.mapInArrow(sign, "id string, sig binary, shingles array<bigint>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature's bands: the bucket is a hash of the band's number and values."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, BANDS)  # four values make one number
        mixed = (sig ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0])) * _MIX[1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]
        n = len(sig)
        at = pa.array(np.repeat(np.arange(n), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array((mixed ^ (mixed >> np.uint64(31))).view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), n)), b.column(0).take(at), b.column(1).take(at)], ["bucket", "band", "place", "h"])


def _compare(steps: list[tuple[int, int]]):  # type: ignore[no-untyped-def]
    def pairs(bucket: np.ndarray, band: np.ndarray, side: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the pairs in sorted rows that survive the pruning."""
        for d in range(1, len(bucket)):
            p = np.flatnonzero(bucket[:-d] == bucket[d:])
            if not len(p):
                break
            p = p[(side[p] < 0) | (side[p] != side[p + d])]
            for n, needed in steps:
                if len(p):
                    p = p[(sig[p, :n] == sig[p + d, :n]).sum(axis=1) >= needed]
            if len(p):
                agree = (sig[p] == sig[p + d]).reshape(-1, BANDS, ROWS).all(axis=2)
                p = p[agree.argmax(axis=1) == band[p]]
                yield p, p + d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = np.stack([np.asarray(t.column("bucket")), np.asarray(t.column("block"))])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            whole = int(changes[-1]) + 1 if len(changes) else 0  # the last bucket may go on
            yield from one(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None:
            yield from one(rest)

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(t) < 2:
            return
        key = np.stack([np.asarray(t.column("bucket")), np.asarray(t.column("block"))])
        bucket = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        ids = t.column("place").combine_chunks()
        for p, q in pairs(bucket, np.asarray(t.column("band")), np.asarray(t.column("side")), sig):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), ids.take(pa.array(q))], ["x", "y"])

    return run


def similar(df: DataFrame, threshold: float = 0.7, run: int = 3, least: int = 25, tolerance: float = 1e-4) -> DataFrame:
    """hash_a < hash_b and their similarity: the pairs of different chunk_hash whose texts are similar by at least threshold.

    The similarity is the number of distinct runs of words found in both texts divided by the number
    found in either. df has chunk_hash and chunk_text; others are not read. Rows with a null in
    either take no part, nor do texts of fewer than least words, the empty one among them; copies
    of a chunk_hash count once. An empty table gives no rows.
    """
    signed = written(signatures(df, run, least).withColumn("place", F.monotonically_increasing_id()))
    bands = signed.select("place", F.xxhash64("id").alias("h"), "sig").mapInArrow(_buckets, "bucket bigint, band tinyint, place bigint, h bigint")
    # one shuffle of numbers by bucket: copies are reduced to the first, and buckets of one text left out
    alone = bands.repartition("bucket").groupBy("bucket", "h").agg(F.min("place").alias("place"), F.first("band").alias("band"))
    members = alone.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1")
    members = members.join(signed.select("place", "sig"), "place")
    # a bucket of many members is dealt out to blocks, each of which meets itself and every other one
    many = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("place"), many).cast("int")
    members = members.withColumn("blocks", many).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    members = members.select("bucket", (low * F.col("blocks") + high).alias("block"), "band", F.when(low == high, -1).when(F.col("mine") == low, 0).otherwise(1).cast("tinyint").alias("side"), "place", "sig")
    steps = [(n, least_matches(threshold, tolerance, n)) for n in (16, 32, 48, 64, 96)]
    met = written(members.repartition("bucket", "block").sortWithinPartitions("bucket", "block").mapInArrow(_compare(steps), "x bigint, y bigint"))
    # the size of what is left is known here, so that Spark joins the shingles of few pairs without a shuffle
    side = lambda name, id: signed.select(F.col("place").alias(name), F.col("id").alias(id), F.col("shingles").alias(f"{id}_set"))
    both = met.join(side("x", "a"), "x").join(side("y", "b"), "y")
    common = F.size(F.array_intersect("a_set", "b_set"))
    both = both.select(F.least("a", "b").alias("hash_a"), F.greatest("a", "b").alias("hash_b"), common.alias("c"), (F.size("a_set") + F.size("b_set") - common).alias("u"))
    return both.where(F.col("c") >= threshold * F.col("u") - 1e-9).select("hash_a", "hash_b", (F.col("c") / F.col("u")).alias("similarity"))


def components(pairs: DataFrame) -> DataFrame:
    """id and group_id, the least id that can be reached over pairs hash_a, hash_b, for each id in them.

    Rounds of joining to the least neighbour and of shortening the way to it, each written to the
    shared folder, until nothing changes: their number grows with the logarithm of a group's width.
    """
    edges = written(pairs.select(F.col("hash_a").alias("u"), F.col("hash_b").alias("v")))
    while True:
        # every node points to the least node of its neighbourhood, and so do its neighbours
        sides = edges.union(edges.select("v", "u"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        smaller = large.distinct().union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = smaller.groupBy("u").agg(F.min("v").alias("m"))
        small = smaller.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after.select("u", "v")
        if not changed:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(edges.select("v", "v").distinct())


def groups(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """group_id, chunk_hash, repo_id and file_path of the members of each group of similar texts, copies included."""
    of = components(pairs)
    rows = df.select("chunk_hash", "repo_id", "file_path").where("chunk_hash is not null").distinct()
    return rows.join(of.withColumnRenamed("id", "chunk_hash"), "chunk_hash").select("group_id", "chunk_hash", "repo_id", "file_path")
