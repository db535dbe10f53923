"""Latest row per key, duplicates, upserts and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _total_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str]:
    return [*order, *(c for c in df.columns if c not in order and c not in keys)]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order columns of each key; the other columns break ties, nulls come last.

    A maximum of structs: rows are combined before the shuffle and no group is sorted or held.
    """
    rest = _total_order(df, keys, order)
    if len(rest) == 1:  # a plain maximum needs no sort
        return df.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*df.columns)
    top = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_top"))
    return top.select(*(F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in df.columns))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """Rank 1 is the row that latest_per_key() keeps."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in _total_order(df, keys, order)))
    return df.withColumn(name, F.row_number().over(w))


def duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str) -> DataFrame:
    """The rows that latest_per_key() drops, with the quarantine columns."""
    return ranked(df, keys, order).where("_rank > 1").drop("_rank").withColumns({"_quarantine_source": F.lit(source), "_quarantine_reason": F.lit("duplicate")})


def upserted(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], created: str | None = None) -> DataFrame:
    """Target and batch with the latest row per key; created: a column whose earliest value of the key stays."""
    out = latest_per_key(target.unionByName(batch), keys, order)
    if not created:
        return out
    first = target.unionByName(batch).groupBy(*keys).agg(F.min(created).alias("_first"))
    return out.join(first, list(keys)).withColumn(created, F.col("_first")).select(*out.columns)


def type1_merged(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str], created: str, updated: str, at: Column) -> DataFrame:
    """Target with the batch's latest rows merged in: known keys keep their created time, new values get the updated time."""
    new = latest_per_key(batch, keys, order)
    kept = target.join(new.select(*keys), list(keys), "left_anti")
    old = target.select(*keys, F.col(created).alias("_created"))
    merged = new.join(old, list(keys), "left").withColumn(created, F.coalesce("_created", created)).withColumn(updated, at)
    return kept.unionByName(merged.select(*target.columns))
