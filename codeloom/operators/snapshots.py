"""Changes between two snapshots of files, and what is already stored."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def changes(old: DataFrame, new: DataFrame, key: Sequence[str], content: str = "content_hash") -> DataFrame:
    """key, change (added, modified, deleted) and both hashes of what differs; keys are unique in each snapshot."""
    a = old.select(*key, F.col(content).alias("old_hash"), F.lit(True).alias("was"))
    b = new.select(*key, F.col(content).alias("new_hash"), F.lit(True).alias("is"))
    both = a.join(b, list(key), "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return both.withColumn("change", change).where("change is not null").select(*key, "change", "old_hash", "new_hash")


def renames(changed: DataFrame, scope: str, path: str) -> DataFrame:
    """changed, with files of equal content that were deleted in one place and added in another as renamed, with old_path; each is used once, in order of the paths."""
    w = Window.partitionBy(scope, "hash").orderBy(path)
    gone = changed.where("change = 'deleted'").select(scope, F.col("old_hash").alias("hash"), path).withColumn("nth", F.row_number().over(w)).select(scope, "hash", "nth", F.col(path).alias("old_path"))
    come = changed.where("change = 'added'").select(scope, F.col("new_hash").alias("hash"), path).withColumn("nth", F.row_number().over(w))
    pairs = come.join(gone, [scope, "hash", "nth"]).select(scope, path, "old_path")
    used = pairs.select(scope, F.col("old_path").alias(path))
    rest = changed.join(used, [scope, path], "left_anti").join(pairs, [scope, path], "left")
    return rest.withColumn("change", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change")))


def touched(old: DataFrame, new: DataFrame, key: str, when: str) -> DataFrame:
    """key and state (new, changed, unchanged, deleted) by time of change."""
    both = old.select(key, F.col(when).alias("old_at"), F.lit(True).alias("was")).join(new.select(key, F.col(when).alias("new_at"), F.lit(True).alias("is")), key, "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("new_at") > F.col("old_at"), "changed").otherwise("unchanged")
    return both.select(key, state.alias("state"))


def unseen(new: DataFrame, stored: DataFrame, key: Sequence[str] = ("repo_id", "chunk_hash")) -> DataFrame:
    """The rows of new whose hash is not stored yet in their repository; equal rows within new all stay."""
    return new.join(stored.select(*key).distinct(), list(key), "left_anti")


def changed_lines(old: DataFrame, new: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """key, start_line and end_line of the ranges of lines of new that are not in old, by a diff of each file; keys are unique in each snapshot.

    A file that is not in old is one range; where lines were only removed, the range is the line before
    (the first, at the beginning). Null texts are empty, equal ones have no ranges.
    """
    both = new.select(*key, F.col(text).alias("b")).join(old.select(*key, F.col(text).alias("a")), list(key), "left")
    differing = both.where(~F.coalesce("a", F.lit("")).eqNullSafe(F.coalesce("b", F.lit(""))))
    schema = T.StructType([*[new.schema[k] for k in key], T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])

    def run(batches):  # type: ignore[no-untyped-def]
        for b in batches:
            rows, starts, ends = [], [], []
            for i, (fresh, before) in enumerate(zip(b.column(len(key)).to_pylist(), b.column(len(key) + 1).to_pylist(), strict=True)):
                lines = (fresh or "").split("\n")
                for tag, _, _, j1, j2 in SequenceMatcher(None, (before or "").split("\n") if before is not None else [], lines, autojunk=False).get_opcodes():
                    if tag != "equal":
                        rows.append(i)
                        starts.append(max(1, j1 + (j2 > j1)))
                        ends.append(max(1, j2))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in b.columns[: len(key)]], pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=schema.names)

    return differing.select(*key, "b", "a").mapInArrow(run, schema)
