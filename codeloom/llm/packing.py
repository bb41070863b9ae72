"""Problem 9: filling containers of fixed capacity, by sum-of-squares online packing.

Each item goes to the fill level that leaves the smallest sum of squared counts of partly filled
containers. The counts are an array by level, so a choice costs one pass over the levels whatever
the number of containers. Tasks pack their own rows as these stream by; what containers are left
badly filled at a task's end is opened again, brought together from all tasks and packed a second
time in the same way, in as many tasks as there are items for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.base import TOKENIZERS, written
from codeloom.llm.tokens import encoder

#: Items that a task of the second pass packs; each leaves some containers badly filled.
PER_TASK = 20_000

#: doc_id, the part of its text (from 1), first token of the part (from 0), tokens.
Item = tuple[int, int, int, int]


class Levels:
    """Open containers by fill level, 1 to capacity - 1."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # at 0 a new container, at capacity a full one: both count nothing
        self.open: dict[int, list[list[Item]]] = defaultdict(list)

    def add(self, item: Item) -> list[Item] | None:
        """Place an item; the container if that filled it."""
        size = item[3]
        n = self.count
        # moving one container from level h to h + size changes the sum of squares by 2 (n[h + size] - n[h] + 1),
        # by 1 less where one of the levels isn't counted
        cost = 2 * (n[size:] - n[: self.capacity + 1 - size]) + 2
        cost[1:][n[1 : self.capacity + 1 - size] == 0] = np.iinfo(np.int64).max
        cost[0] -= 1
        if self.capacity > size:
            cost[-1] -= 1  # the full level
        h = int(cost.argmin())
        if h:
            box = self.open[h].pop()
            n[h] -= 1
        else:
            box = []
        box.append(item)
        if h + size == self.capacity:
            return box
        self.open[h + size].append(box)
        n[h + size] += 1
        return None

    def rest(self) -> Iterator[tuple[int, list[Item]]]:
        for level in sorted(self.open):
            for box in self.open[level]:
                yield level, box


SCHEMA = "container_id string, doc_id bigint, part int, first_token int, n_tokens int"


def _rows(boxes: list[tuple[str | None, Item]]) -> pa.RecordBatch:
    cols = list(zip(*[(c, *i) for c, i in boxes], strict=True)) or [[]] * 5
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["container_id", "doc_id", "part", "first_token", "n_tokens"])


def pack(df: DataFrame, key: Column, text: Column, capacity: int = 2048, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", settled: float = 0.98) -> DataFrame:
    """container_id, doc_id, part, first_token and n_tokens: where the tokens of each row of df go.

    A text of at most capacity tokens is never split; a longer one gives full containers and a last
    part that is packed as an item. Null and empty texts take no room and have one row with a null
    container and 0 tokens. Rows with one key are separate items. settled: containers filled to this
    share stay as the first pass leaves them. An empty table gives no rows; other columns of df
    are not read.
    """
    rounds = capacity * settled

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, levels = encoder(path), Levels(capacity)
        name, n = f"a{TaskContext.get().partitionId()}", 0  # type: ignore[union-attr]
        for b in batches:
            out: list[tuple[str | None, Item]] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size = e.count(t)
                if size == 0:
                    out.append((None, (doc, 1, 0, 0)))
                    continue
                for part, at in enumerate(range(0, size, capacity), 1):
                    done = levels.add((doc, part, at, min(capacity, size - at)))
                    if done:
                        n += 1
                        out += [(f"{name}-{n}", i) for i in done]
            yield _rows(out)
        out = []
        for level, box in levels.rest():
            n += 1
            out += [(f"{name}-{n}" if level >= rounds else "", i) for i in box]
        yield _rows(out)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(capacity)
        name, n = f"b{TaskContext.get().partitionId()}", 0  # type: ignore[union-attr]
        out: list[tuple[str | None, Item]] = []
        for b in batches:
            for item in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True):
                done = levels.add(item)
                if done:
                    n += 1
                    out += [(f"{name}-{n}", i) for i in done]
        for _, box in levels.rest():
            n += 1
            out += [(f"{name}-{n}", i) for i in box]
        yield _rows(out)

    items = df.select(key.cast("bigint").alias("doc_id"), text.alias("text"))
    once = written(items.mapInArrow(first, SCHEMA))  # container names must not change if a task is run again
    again = once.where("container_id = ''")
    tasks = max(1, -(-again.count() // PER_TASK))
    again = written(again.repartition(tasks, F.xxhash64("doc_id", "part")).mapInArrow(second, SCHEMA))
    return once.where("container_id is null or container_id <> ''").unionByName(again)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of the containers' room that is filled."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("filled"), F.max("n").alias("fullest"))
