"""Writes on parquet: append, partition overwrite, upsert and merge through a staging path, audit log."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists, read_target
from .checks import stringified
from .dedup import type1_merged, upserted
from .scd2 import published

META = ("_quarantine_source", "_quarantine_reason", "_quarantine_null_cols", "_quarantine_ts", "_quarantine_date")


def append(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    out = df.repartition(*partitions) if partitions else df
    out.write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace only the partitions that the frame has."""
    df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cardmart-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the folder in spark.checkpoint.dir, so that several branches read it and none computes it again."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of paths."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), Path


def _rename(fs, source, target) -> None:
    """A rename that reports its failure (Hadoop's returns false)."""
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def restore(spark: SparkSession, path: str) -> None:
    """Undo a swap that ended between its two renames: the target is missing and its old folder still there."""
    fs, Path = files(spark, path)
    target = Path(path.rstrip("/"))
    if fs.exists(target) or not fs.exists(target.getParent()):
        return
    old = sorted((f.getModificationTime(), f.getPath().toString()) for f in fs.listStatus(target.getParent()) if f.getPath().getName().startswith(f"{target.getName()}.old-"))
    if old:
        _rename(fs, Path(old[-1][1]), target)


def replace(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Write beside the target, then swap: the frame may read the target itself.

    Where a rename fails, the target is what it was, and nothing is left beside it.
    """
    spark = df.sparkSession
    staging, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staging", "old"))
    fs, Path = files(spark, path)
    try:
        overwrite(df, staging, partitions)
        there = fs.exists(Path(path))
        if there:
            _rename(fs, Path(path), Path(old))
        try:
            _rename(fs, Path(staging), Path(path))
        except Exception:
            if there:
                _rename(fs, Path(old), Path(path))
            raise
        fs.delete(Path(old), True)
    finally:
        fs.delete(Path(staging), True)


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partitions: Sequence[str] = (), created: str | None = None) -> None:
    """The latest row per key; with partitions, only those that the batch touches are read and replaced."""
    spark = batch.sparkSession
    restore(spark, path)
    target = read_target(spark, path, batch.schema)
    if not partitions:
        return replace(upserted(target, batch, keys, order, created), path)
    touched = target.join(batch.select(*partitions).distinct(), list(partitions), "left_semi")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, Path = files(spark, path)
    try:
        overwrite(upserted(touched, batch, keys, order, created), staging)
        overwrite_partitions(spark.read.parquet(staging), path, partitions)
    finally:
        fs.delete(Path(staging), True)


def merge(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], created: str, updated: str) -> None:
    restore(batch.sparkSession, path)
    target = read_target(batch.sparkSession, path, batch.schema)
    replace(type1_merged(target, batch, keys, order, created, updated, F.col(updated)), path)


def append_newer(batch: DataFrame, path: str, ts: str, partitions: Sequence[str] = ()) -> None:
    """Only the rows that are newer than the newest of the target."""
    newest = read_target(batch.sparkSession, path, batch.schema).agg(F.max(ts)).first()[0]
    append(batch if newest is None else batch.where(F.col(ts) > F.lit(newest)), path, partitions)


def publish_history(batch: DataFrame, path: str, key: str, tracked: Sequence[str], at: str, late: str = "split", order: Sequence[str] = ()) -> None:
    """The state at a time as a further batch of an SCD2 table (see scd2.published()); batches may come late, twice, and with repeated keys."""
    spark = batch.sparkSession
    restore(spark, path)
    before = spark.read.parquet(path) if path_exists(spark, path) else None
    replace(published(before, batch, key, tracked, F.lit(at).cast("timestamp_ntz"), late, order), path)


def quarantine(rejected: DataFrame, path: str) -> None:
    """All business columns as text, by source and date."""
    rows = rejected if "_quarantine_date" in rejected.columns else rejected.withColumn("_quarantine_date", F.current_date())
    append(stringified(rows, META), path, ["_quarantine_source", "_quarantine_date"])


def stamped(df: DataFrame, batch: str, run: str, source: str | None = None, at: str | None = None) -> DataFrame:
    """Audit columns: created and updated time, source file, run, logical date, deletion flag."""
    now = F.lit(at).cast("timestamp_ntz") if at else F.localtimestamp()
    file = F.lit(source) if source else F.input_file_name()
    return df.withColumns({"_created_at": now, "_source_file": file, "_processing_id": F.lit(run), "_updated_at": now, "_batch_logical_date": F.lit(batch).cast("timestamp_ntz"), "_is_deleted": F.lit(False)})


AUDIT = "pipeline_name string, dataset_name string, check_name string, severity string, passed boolean, detail string, run_id string, dt string"


def log_audit(spark: SparkSession, rows: list[tuple], path: str) -> None:
    append(spark.createDataFrame(rows, AUDIT), path, ["dt", "pipeline_name", "dataset_name"])


MODES: dict[str, Callable] = {"append": append, "overwrite": overwrite, "partition_overwrite": overwrite_partitions, "upsert": upsert, "merge": merge, "append_newer": append_newer, "scd2": publish_history}


def write(df: DataFrame, mode: str, path: str, **options) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown write mode: {mode}")
    MODES[mode](df, path, **options)
