"""Reading tables, tables written between stages, and changes to stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors must share; a temporary one only where the session is local and names none, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


_written: dict[int, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: this cuts the lineage, and survives the loss of executors.

    The folder is removed by discard, by free, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _written.setdefault(id(spark.sparkContext), []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a table that written gave, once nothing that is still to run reads it, as between rounds."""
    path = getattr(df, "_codeloom_path", None)
    if path is not None:
        _remove(df.sparkSession, path)
        _written[id(df.sparkSession.sparkContext)].remove(path)


def free(spark: SparkSession) -> int:
    """Removes all tables that written has left in the shared folder, when the results that read them have been used; their number."""
    paths = _written.pop(id(spark.sparkContext), [])
    for path in paths:
        _remove(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it comes from fewer files than there are, for costly narrow stages; many files are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with the columns of schema: missing ones are added with their default, further ones are kept behind."""
    defaults = defaults or {}
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in schema.names])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | list[str]) -> DataFrame:
    """old with the rows of new put in by key, the last of new by sequence winning; sequence is dropped.

    Rows of null keys in new are dropped; no change happens in place, the result is a new version.
    """
    order = [sequence] if isinstance(sequence, str) else sequence
    data = [c for c in new.columns if c not in order]
    last = new.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in data if c not in keys]), F.struct(*order)).alias("row")).select(*keys, "row.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def sparse_update(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """old with each value that is not null in patch, of which keys are unique, in place of its own."""
    p = patch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in patch.columns if c not in keys])
    changed = {c for c in patch.columns if c not in keys}
    return old.join(p, keys, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns])


def replace_files(old: DataFrame, new: DataFrame, keys: tuple[str, str] = ("repo_id", "file_path")) -> DataFrame:
    """old without the rows of the files that new has any row of, and with new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(old: DataFrame, gone: DataFrame, keys: tuple[str, str] = ("repo_id", "file_path")) -> DataFrame:
    """old without the rows of the files in gone."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def append_chunks(df: DataFrame, path: str) -> None:
    """Appends chunk rows to the store at path, partitioned by repository so that scans of one are pruned."""
    df.withColumn("indexed_at", F.coalesce("indexed_at", F.current_timestamp()) if "indexed_at" in df.columns else F.current_timestamp()).write.mode("append").partitionBy("repo_id").parquet(path)
