"""Problem 5: the k most similar vectors of every vector, by a hierarchical k-means tree.

The upper part of the tree is fitted on a bounded sample and sent to all tasks. Its leaves are
gathered in blocks of some thousand vectors. A block that turns out to hold more gets a tree of its
own, fitted on a bounded sample of its vectors, in as many levels as the number of vectors needs. A
query walks the tree best bin first: the nodes it may go on to wait in a heap, and the most similar
one is taken next, until what is left is less similar by a gap that is widened until queries answered
by brute force over all vectors find the wanted share of their neighbours. Within a block a tree of all
of its vectors is walked in the same way, the gap being that of the block's own queries. Blocks that very many queries visit are searched in several tasks. Equal vectors are searched
once, and their groups put in afterwards, so that no group of copies meets in one task.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.base import written

#: Vectors of the sample on which the upper tree is fitted, and of those for the trees of blocks that hold too many.
SAMPLE, SAMPLE_BELOW = 32_768, 8_192
#: Queries whose true neighbours calibrate how far the walk goes.
QUERIES = 512
#: Vectors that a block should hold; one of thrice as many is parted again.
BLOCK = 8_192
#: Vectors of the sample that a leaf of a fitted tree should hold at least.
TWIG = 24
#: Vectors that a leaf within a block should hold.
LEAF = 128
#: Children of a node.
BRANCHES = 8


def usable(embedding: Column, width: int) -> Column:
    """Not null, of the given width, finite throughout and not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == width) & fine & F.exists(embedding, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lest squares overflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres on the unit sphere, and the centre of each vector. Centres that lose all their vectors are left out."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = (of[:, None] == np.arange(len(centres))).astype(np.float32).T @ x
        norms = np.linalg.norm(sums, axis=1)
        centres = (sums[norms > 1e-9] / norms[norms > 1e-9, None]).astype(np.float32)
    return centres, (x @ centres.T).argmax(axis=1)


def top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row with their ids, unordered."""
    if sims.shape[1] <= k:
        return sims, ids
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Tree:
    """A k-means tree over some vectors, each of which stands for share others.

    The children of a node are numbered one after another. Leaves hold at most small vectors, or are
    too few to be parted further; the leaves below a node of at most block vectors share a block.
    """

    def __init__(self, x: np.ndarray, share: float, small: int, least: int, block: int):
        first, count, of_block, rows = [0], [0], [-1], [np.arange(len(x))]
        blocks = at = 0
        while at < len(rows):
            mine = rows[at]
            size = len(mine) * share
            if of_block[at] < 0 and size <= block:
                of_block[at], blocks = blocks, blocks + 1
            if size > small and len(mine) >= 2 * least:
                _, to = kmeans(x[mine], BRANCHES, seed=at)
                parts = [p for p in (mine[to == j] for j in range(to.max() + 1)) if len(p)]
                if len(parts) > 1:
                    first[at], count[at] = len(rows), len(parts)
                    for p in parts:
                        first.append(0)
                        count.append(0)
                        of_block.append(of_block[at])
                        rows.append(p)
            if not count[at] and of_block[at] < 0:
                of_block[at], blocks = blocks, blocks + 1
            at += 1
        means = np.stack([x[r].mean(axis=0) if len(r) else np.zeros(x.shape[1]) for r in rows])
        self.centres = (means / np.maximum(1e-9, np.linalg.norm(means, axis=1, keepdims=True))).astype(np.float32)
        #: how similar a node's own vectors are to its centre: by this, nodes of all levels can be compared
        self.usual = np.array([(x[r] @ c).mean() if len(r) else 1 for r, c in zip(rows, self.centres, strict=True)], np.float32)
        self.first, self.count, self.block, self.blocks = first, count, of_block, blocks
        self.leaves = {i: r for i, r in enumerate(rows) if not count[i]}
        self.size = [len(r) * share for r in rows]

    def walk(self, v: np.ndarray) -> Iterator[tuple[int, float]]:
        """The leaves for a query, best bin first, each with the least similarity of a node taken so far.

        Only the children of nodes that are taken are compared with the query.
        """
        heap = [(-9.0, 0)]
        first, count, centres, usual = self.first, self.count, self.centres, self.usual
        least = 9.0
        while heap:
            s, node = heapq.heappop(heap)
            if node:
                least = min(least, -s)
            at, n = first[node], count[node]
            if not n:
                yield node, least
                continue
            for s in (centres[at : at + n].dot(v) - usual[at : at + n]).tolist():
                heapq.heappush(heap, (-s, at))
                at += 1

    def within(self, v: np.ndarray, gap: float, enough: float = 0) -> list[int]:
        """The leaves that a query reaches before a node must be taken that is less similar than the first leaf's way by the gap, and that hold enough vectors."""
        heap = [(-9.0, 0)]
        first, count, centres, usual = self.first, self.count, self.centres, self.usual
        out: list[int] = []
        least, bound, held = 9.0, -9.0, 0.0
        while heap:
            s, node = heapq.heappop(heap)
            if -s < bound and held >= enough:
                break
            at, n = first[node], count[node]
            if n:
                if node and not out:
                    least = min(least, -s)
                for s in (centres[at : at + n].dot(v) - usual[at : at + n]).tolist():
                    heapq.heappush(heap, (-s, at))
                    at += 1
            else:
                if not out:
                    bound = min(least, -s) - gap
                out.append(node)
                held += self.size[node]
        return out

    def visited(self, q: np.ndarray, gap: float, enough: float = 64) -> list[list[int]]:
        """The blocks that each query reaches, its own first."""
        block = self.block
        return [list(dict.fromkeys([block[leaf] for leaf in self.within(v, gap, enough)])) for v in q]

    def needed(self, q: np.ndarray, homes: list[int], of: Callable[[int], int]) -> list[float]:
        """The gap within which each query reaches the home that is given for it; of: the home that a leaf is."""
        out = []
        for v, home in zip(q, homes, strict=True):
            walk = self.walk(v)
            leaf, best = next(walk)
            least = best
            while of(leaf) != home:
                leaf, least = next(walk)
            out.append(best - least)
        return out


def truth(vectors: DataFrame, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Some queries, repeated, and their k true neighbours, found by brute force over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = np.full((len(q), k + 1), -9, np.float32)
        near = np.zeros((len(q), k + 1, q.shape[1]), np.float32)
        for b in batches:
            x = unit(np.asarray(b.column(0).flatten(), np.float32).reshape(-1, q.shape[1]))
            sims, at = top(q @ x.T, np.broadcast_to(np.arange(len(x)), (len(q), len(x))), k + 1)
            both, vectors = np.concatenate([best, sims], axis=1), np.concatenate([near, x[at]], axis=1)
            best, kept = top(both, np.broadcast_to(np.arange(both.shape[1]), both.shape), k + 1)
            near = np.take_along_axis(vectors, kept[:, :, None], 1)
        n = np.repeat(np.arange(len(q)), best.shape[1])
        there = best.ravel() > -2
        yield pa.RecordBatch.from_arrays([pa.array(n[there], pa.int32()), pa.array(best.ravel()[there], pa.float32()), pa.array([v.tobytes() for v in near.reshape(-1, q.shape[1])[there]], pa.binary())], ["q", "sim", "near"])

    found = vectors.select("embedding").mapInArrow(run, "q int, sim float, near binary")
    order = Window.partitionBy("q").orderBy(F.desc("sim"))
    nearest = found.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k + 1)).select("q", "near").toArrow()  # the first is the query
    near = np.frombuffer(b"".join(nearest.column("near").to_pylist()), np.float32).reshape(-1, q.shape[1])
    return q[np.asarray(nearest.column("q"), np.int64)], near


def enough(needed: list[float], recall: float) -> float:
    """The gap that is enough for the wanted share of neighbours."""
    return sorted(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1e-6 if needed else 0.0


def search_block(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of q the k most similar of x, and their positions; own is a query's position in x, or -1."""
    n = len(x)

    def brute(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = q[rows] @ x.T
        mine = own[rows] >= 0
        sims[np.flatnonzero(mine), own[rows][mine]] = -9
        return top(sims, np.broadcast_to(np.arange(n), sims.shape), k)

    if n <= 4 * LEAF:
        return brute(np.arange(len(q)))
    tree = Tree(x, 1, LEAF, LEAF // 2, n)
    leaf_of = np.empty(n, np.int64)
    for leaf, members in tree.leaves.items():
        leaf_of[members] = leaf
    at_home = np.flatnonzero(own >= 0)
    probe = np.random.default_rng(2).choice(at_home, min(256, len(at_home)), replace=False) if len(at_home) else np.arange(0)
    true = brute(probe)[1]
    gap = enough(tree.needed(np.repeat(q[probe], true.shape[1], axis=0), leaf_of[true].ravel().tolist(), lambda leaf: leaf), recall)
    best = np.full((len(q), k), -9, np.float32)
    ids = np.full((len(q), k), -1, np.int64)
    for start in range(0, len(q), 8192):
        reached = [tree.within(v, gap, 2 * k + 2) for v in q[start : start + 8192]]
        rows_of = np.repeat(np.arange(start, start + len(reached)), [len(r) for r in reached])
        leaf = np.fromiter(chain.from_iterable(reached), np.int64, len(rows_of))
        by = np.argsort(leaf, kind="stable")
        bounds = np.searchsorted(leaf[by], np.arange(len(tree.centres) + 1))
        for j, members in tree.leaves.items():
            rows = rows_of[by[bounds[j] : bounds[j + 1]]]
            if len(rows):
                sims = q[rows] @ x[members].T
                sims[own[rows][:, None] == members[None, :]] = -9
                s, i = top(sims, np.broadcast_to(members, sims.shape), k)
                best[rows], ids[rows] = top(np.concatenate([best[rows], s], axis=1), np.concatenate([ids[rows], i], axis=1), k)
    return best, ids


def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


ROUTED = "block string, id string, multi boolean, own boolean, alone boolean, vector binary"


def _spread(tree: Tree, x: np.ndarray, ids: pa.Array, multi: pa.Array, own: np.ndarray, alone: np.ndarray, gap: float, prefix: str, parts: int = 1) -> pa.RecordBatch:
    """The rows of ROUTED of some queries: one for each block they visit, their own with own set.

    parts: into how many blocks vectors are dealt that the tree cannot tell apart, each of which all queries visit.
    """
    if parts > 1:
        of = [zlib.crc32(i.encode()) % parts for i in ids.to_pylist()]
        visited = [[f"={(o + j) % parts}" for j in range(parts)] for o in of]
    else:
        visited = tree.visited(x, gap)
    n = np.array([len(v) for v in visited], np.int64)
    at = np.repeat(np.arange(len(x)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    mine = np.zeros(len(at), bool)
    mine[first[own]] = True
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    take = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [pa.array([f"{prefix}{b}" for v in visited for b in v], pa.string()), ids.take(take), multi.take(take), pa.array(mine), pa.array((alone & (n == 1))[at]), data.take(take)], ["block", "id", "multi", "own", "alone", "vector"]
    )


def part_again(routed: DataFrame, q: np.ndarray, near: np.ndarray, home: list[str], width: int, recall: float) -> tuple[DataFrame, list[str], bool]:
    """routed with the blocks of too many vectors parted by trees of their own, the new home of each neighbour, and whether any was."""
    spark = routed.sparkSession
    counts = routed.where("own").groupBy("block").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 3 * BLOCK) & ~F.contains("block", F.lit("=")))
    if counts.isEmpty():
        return routed, home, False
    large = written(counts)
    below, twig, block = SAMPLE_BELOW, TWIG, BLOCK

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        x, n = _vectors(t.column("vector"), width), t.column("n")[0].as_py()
        tree = Tree(x, n / len(x), twig * 8, twig, block)
        tree.leaves = {}
        return pa.table({"block": [key[0].as_py()], "tree": pa.array([pickle.dumps((tree, 1 if tree.blocks > 1 else -(-n // block)))], pa.binary())})

    some = routed.where("own").join(large, "block").where(F.pmod(F.xxhash64("id", F.lit(3)), F.col("n")) < below)
    trees = written(some.select("block", "n", "vector").groupBy("block").applyInArrow(fit, "block string, tree binary"))
    pairs = spark.createDataFrame(pa.table({"pair": pa.array(range(len(home)), pa.int32()), "block": pa.array(home, pa.string()), "q": pa.array([v.tobytes() for v in q], pa.binary()), "near": pa.array([v.tobytes() for v in near], pa.binary())}))

    def need(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"pair": [], "home": [], "needed": []}
        if len(right) and len(left):
            tree, _ = pickle.loads(right.column("tree")[0].as_py())
            to = [v[0] for v in tree.visited(_vectors(left.column("near"), width), 0.0)]
            out = {"pair": left.column("pair").to_pylist(), "home": [f"{b}/{j}" for b, j in zip(left.column("block").to_pylist(), to, strict=True)], "needed": tree.needed(_vectors(left.column("q"), width), to, tree.block.__getitem__)}
        return pa.table({"pair": pa.array(out["pair"], pa.int32()), "home": pa.array(out["home"], pa.string()), "needed": pa.array(out["needed"], pa.float64())})

    asked = pairs.groupBy("block").cogroup(trees.groupBy("block")).applyInArrow(need, "pair int, home string, needed double").toArrow().to_pylist()
    gap = enough([r["needed"] for r in asked], recall)
    home = list(home)
    for r in asked:
        home[r["pair"]] = r["home"]

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], pa.schema([("block", pa.string()), ("id", pa.string()), ("multi", pa.bool_()), ("own", pa.bool_()), ("alone", pa.bool_()), ("vector", pa.binary())]))
        tree, parts = pickle.loads(right.column("tree")[0].as_py())
        left = left.combine_chunks()
        one = lambda c: left.column(c).combine_chunks()
        return pa.Table.from_batches([_spread(tree, _vectors(left.column("vector"), width), one("id"), one("multi"), np.asarray(left.column("own"), bool), np.asarray(left.column("alone"), bool), gap, f"{left.column('block')[0].as_py()}/", parts)])

    # a block's rows are dealt out to slices of bounded size, each of which gets the block's tree
    members = routed.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).join(large.select("block"), "block").select("block", F.ceil(F.col("rows") / (4 * BLOCK)).cast("int").alias("slices"))
    sliced = routed.join(members, "block").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(5)), F.col("slices")).cast("int"))
    each = written(trees.join(members, "block")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    parted = sliced.groupBy("block", "slice").cogroup(each.groupBy("block", "slice")).applyInArrow(route, ROUTED)
    return written(routed.join(large.select("block"), "block", "left_anti").select(parted.columns).unionByName(parted)), home, True


NEIGHBOURS = "id string, alone boolean, multi boolean, near array<struct<sim: float, id: string, multi: boolean>>"


def nearest(df: DataFrame, k: int = 5, width: int = 64, recall: float = 0.992) -> DataFrame:
    """chunk_id and near, an array of the k other chunk_ids most similar to it with sim, the cosine, in falling order.

    df has chunk_id and embedding, all copies of a chunk_id the same embedding; others are not read.
    Null ids and unusable embeddings (see usable) take no part. Of equal vectors the smaller ids come
    first. Fewer than k others give shorter arrays; an empty table gives no rows. recall is what
    each level of the tree is calibrated to.
    """
    rows = df.where(F.col("chunk_id").isNotNull() & usable(F.col("embedding"), width)).select("chunk_id", "embedding", F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))
    vectors = written(
        rows.groupBy("h", "g").agg(F.min("chunk_id").alias("id"), F.max("chunk_id").alias("last"), F.first("embedding").alias("embedding")).select("h", "g", "id", (F.col("id") != F.col("last")).alias("multi"), "embedding")
    )
    total = vectors.count()
    if not total:
        return df.sparkSession.createDataFrame([], "chunk_id string, near array<struct<sim: float, id: string>>")
    part = min(1_000_000, int(1_000_000 * SAMPLE / max(1, total)) + 1)
    sampled = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part).select("embedding").limit(SAMPLE).toArrow()
    sample = unit(np.asarray(sampled.column(0).combine_chunks().flatten(), np.float32).reshape(-1, width))
    # the queries that calibrate the walk take no part in the tree, unless there are hardly any vectors
    held = min(QUERIES, len(sample) // 3) if len(sample) >= 16 else 0
    tree = Tree(sample[held:], total / (len(sample) - held), TWIG * 8, TWIG, BLOCK)
    q, near = truth(vectors, sample[:held] if held else sample, k)
    to = [v[0] for v in tree.visited(near, 0.0)]
    gap = enough(tree.needed(q, to, tree.block.__getitem__), recall)
    tree.leaves = {}  # the sample's rows, which are not needed any more
    shared = df.sparkSession.sparkContext.broadcast((tree, gap))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, gap = shared.value
        for b in batches:
            x = unit(np.asarray(b.column(2).flatten(), np.float32).reshape(-1, width))
            yield _spread(tree, x, b.column(0), b.column(1), np.ones(len(x), bool), np.ones(len(x), bool), gap, "")

    def search(t: pa.Table) -> pa.Table:
        everyone = _vectors(t.column("vector"), width)
        mine, asks = np.asarray(t.column("own"), bool), np.asarray(t.column("asks"), bool)
        own = np.where(mine, np.cumsum(mine) - 1, -1)[asks]
        q = everyone[asks]
        ids, multi, alone = (t.column(c).combine_chunks() for c in ("id", "multi", "alone"))
        asking = pa.array(np.flatnonzero(asks))
        if mine.any() and len(q):
            sims, near = search_block(everyone[mine], q, own, k, recall)
        else:
            sims, near = np.full((len(q), 1), -9, np.float32), np.zeros((len(q), 1), np.int64)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims, near = np.take_along_axis(sims, order, 1), np.take_along_axis(near, order, 1)
        there = sims > -2
        rows = pa.array(np.flatnonzero(mine)[near[there]])
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
        entries = pa.StructArray.from_arrays([pa.array(sims[there].astype(np.float32)), ids.take(rows), multi.take(rows)], ["sim", "id", "multi"])
        return pa.table({"id": ids.take(asking), "alone": alone.take(asking), "multi": multi.take(asking), "near": pa.ListArray.from_arrays(offsets, entries)})

    routed = written(vectors.select("id", "multi", "embedding").mapInArrow(route, ROUTED))
    home, again = [str(b) for b in to], True
    while again:
        # what every further level misses adds up, so that each is given a smaller share
        routed, home, again = part_again(routed, q, near, home, width, 1 - (1 - recall) / 8)
    # a block that many visit is searched in slices of its visitors, each with all vectors of the block
    sizes = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("slices"))
    dealt = routed.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("slice", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("mine"))))
    dealt = dealt.select("block", "slice", "id", "multi", "own", "alone", "vector", (F.col("slice") == F.col("mine")).alias("asks"))
    part_lists = written(dealt.groupBy("block", "slice").applyInArrow(search, NEIGHBOURS))
    order = lambda near: F.slice(F.array_sort(near, lambda a, b: F.when(a.sim > b.sim, -1).when(a.sim < b.sim, 1).when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(0)), 1, k)
    whole = part_lists.where("alone").select("id", "multi", order(F.col("near")).alias("near"))
    merged = part_lists.where("not alone").groupBy("id").agg(F.first("multi").alias("multi"), F.flatten(F.collect_list("near")).alias("near")).select("id", "multi", order(F.col("near")).alias("near"))
    lists = whole.unionByName(merged)
    touched = F.col("multi") | F.exists("near", lambda x: x.multi)
    plain = lists.where(~touched).select(F.col("id").alias("chunk_id"), F.transform("near", lambda x: F.struct(x.sim.alias("sim"), x.id.alias("id"))).alias("near"))

    # groups of equal vectors: the k + 1 smallest ids of each stand for it among the neighbours
    members = rows.join(vectors.where("multi").select("h", "g", "id"), ["h", "g"]).select("id", "chunk_id").distinct()
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("chunk_id"))).where(F.col("n") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    steps = lists.where(touched).select("id", F.posexplode(F.concat(F.array(F.struct(F.lit(1.0).cast("float").alias("sim"), F.col("id").alias("id"))), F.transform("near", lambda x: F.struct(x.sim.alias("sim"), x.id.alias("id"))))).alias("pos", "to"))
    steps = steps.select(F.col("id").alias("q"), "pos", F.col("to.sim").alias("sim"), F.col("to.id").alias("id")).join(few, "id", "left")
    steps = steps.select("q", "pos", F.transform(F.coalesce("ids", F.array("id")), lambda i: F.struct(F.col("sim").alias("sim"), i.alias("id"))).alias("part"))
    filled = steps.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")).select(F.col("q").alias("id"), F.flatten(F.transform("parts", lambda p: p.part)).alias("near"))
    each = filled.join(members, "id", "left").select(F.coalesce("chunk_id", "id").alias("chunk_id"), "near")
    each = each.select("chunk_id", F.slice(F.filter("near", lambda x: x.id != F.col("chunk_id")), 1, k).alias("near"))
    return plain.unionByName(each)


def pairs(near: DataFrame) -> DataFrame:
    """chunk_a < chunk_b: the distinct pairs in which at least one is near the other."""
    links = near.select("chunk_id", F.explode("near.id").alias("other"))
    return links.select(F.least("chunk_id", "other").alias("chunk_a"), F.greatest("chunk_id", "other").alias("chunk_b")).distinct()
