"""Change feeds with Structured Streaming: debounced bursts, routing of batches, states of jobs, incremental indexing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeloom.storage import replace_files


def bursts(df: DataFrame, when: str, gap: str, by: Sequence[str] = (), path: str | None = None, late: str | None = None) -> DataFrame:
    """started, ended and n of the runs of rows that a quiet time of gap ends; with path, the distinct paths too.

    On a stream late is the watermark; a burst comes out when it has been quiet for gap beyond it.
    """
    rows = df.withWatermark(when, late) if late else df
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sort_array(F.collect_set(path)).alias("paths")] if path else [])
    keys = list(by) or [F.xxhash64(when).bitwiseAND(F.lit(0)).alias("all_rows")]  # a stream needs a key beside the window, and a literal is none
    found = rows.groupBy(*keys, F.session_window(when, gap).alias("burst")).agg(*aggs)
    return found.select(*by, F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "n", *(["paths"] if path else []))


def only_code(paths: str, extensions: Sequence[str]):  # type: ignore[no-untyped-def]
    """Whether a burst touched nothing but code, so that an index can be rebuilt without a model."""
    return F.forall(paths, lambda p: F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1)).isin(list(extensions)))


def job_states(df: DataFrame, key: str = "id", when: str = "updated_at") -> DataFrame:
    """The last status of each job on a stream of its changes; write it in update mode."""
    return df.groupBy(key).agg(F.max_by("status", when).alias("status"), F.max(when).alias(when), F.count(F.lit(1)).alias("n_changes"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Runs work on every micro-batch with rows."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            work(batch, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def incremental_index(stream: DataFrame, store: str, chunk: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """Keeps a table of chunks in step with a feed of files: the chunks of the files of a batch replace those they had.

    Every batch writes a new version beside the others, store/v<batch>, so that a batch that is run again
    starts from the same version; the highest number is the present one.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
        old = [s.getPath().getName() for s in (fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(store)) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(store)) else [])]
        before = [int(n[1:]) for n in old if n.startswith("v") and n[1:].isdigit() and int(n[1:]) < number]
        new = chunk(batch)
        out = replace_files(spark.read.parquet(f"{store}/v{max(before)}"), new) if before else new
        out.write.mode("overwrite").parquet(f"{store}/v{number}")

    return each_batch(stream, work, checkpoint)
