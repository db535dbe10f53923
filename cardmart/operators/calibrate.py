"""Threshold calibration over merchant totals of a trailing window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import parameter_grid


def last_days(txn: DataFrame, n: int = 30, day: str = "day") -> DataFrame:
    """Transactions of the last n distinct days with data."""
    newest = txn.select(day).distinct().orderBy(F.desc(day)).limit(n)
    return txn.join(F.broadcast(newest), day, "left_semi")  # n rows


def merchant_totals(txn: DataFrame) -> DataFrame:
    """Transactions, failures and gross amount per merchant."""
    return txn.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"), F.sum(F.abs("amount").cast("double")).alias("gross"))


def baseline(txn: DataFrame) -> DataFrame:
    rate = F.count_if("is_error") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return txn.agg(F.countDistinct("merchant_id").alias("merchants"), F.count(F.lit(1)).alias("transactions"), F.count_if("is_error").alias("failed"), F.round(rate, 6).alias("error_rate"))


def floor_cost(totals: DataFrame, floors: Sequence[int]) -> DataFrame:
    """Per floor: merchants, and shares of transactions and gross amount that stay."""
    grid = F.broadcast(parameter_grid(totals.sparkSession, "floor", list(floors)))
    all_n = totals.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"), F.sum("gross").alias("g"))
    kept = grid.join(totals, F.col("n") >= F.col("floor"), "left").groupBy("floor").agg(F.count("merchant_id").alias("merchants"), F.sum("n").alias("kt"), F.sum("gross").alias("kg"))
    share = lambda a, b: F.round(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 6)
    return kept.crossJoin(F.broadcast(all_n)).select("floor", "merchants", share("merchants", "m").alias("merchant_share"), share("kt", "t").alias("transaction_share"), share("kg", "g").alias("gross_share"))


def volume_percentiles(totals: DataFrame, points: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    p = F.percentile_approx("n", list(points), 100_000)
    return totals.agg(p.alias("p")).select(*(F.col("p")[k].alias(f"p{round(100 * x)}") for k, x in enumerate(points)))


def rate_percentiles(totals: DataFrame, floors: Sequence[int], points: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles of the error rate among the merchants of each floor."""
    grid = F.broadcast(parameter_grid(totals.sparkSession, "floor", list(floors)))
    p = F.percentile_approx(F.col("failed") / F.col("n"), list(points), 100_000)
    out = grid.join(totals, F.col("n") >= F.col("floor")).groupBy("floor").agg(F.count(F.lit(1)).alias("merchants"), p.alias("p"))
    return out.select("floor", "merchants", *(F.round(F.col("p")[k], 6).alias(f"p{round(100 * x)}") for k, x in enumerate(points)))


def flag_counts(totals: DataFrame, floors: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """Merchants above each threshold for each floor."""
    s = totals.sparkSession
    grid = F.broadcast(parameter_grid(s, "floor", list(floors)).crossJoin(parameter_grid(s, "threshold", list(thresholds))))
    hit = F.col("failed") / F.col("n") > F.col("threshold")
    return grid.join(totals, F.col("n") >= F.col("floor")).groupBy("floor", "threshold").agg(F.count(F.lit(1)).alias("merchants"), F.count_if(hit).alias("flagged"))


def flagged_head(totals: DataFrame, floor: int, threshold: float, limit: int) -> DataFrame:
    """The merchants with the highest rates above the threshold, with the failures that the baseline leads to expect."""
    base = totals.agg((F.sum("failed") / F.sum("n")).alias("b"))
    rate = F.col("failed") / F.col("n")
    rows = totals.where((F.col("n") >= floor) & (rate > threshold)).crossJoin(F.broadcast(base))
    return rows.select("merchant_id", "n", "failed", F.round(rate, 6).alias("error_rate"), F.round(F.col("n") * F.col("b"), 2).alias("expected_failed")).orderBy(F.desc("error_rate"), "merchant_id").limit(limit)


def dispersion(totals: DataFrame, floors: Sequence[int]) -> DataFrame:
    """Chi-square of failures against the rate of the merchants of each floor, over its degrees of freedom."""
    grid = F.broadcast(parameter_grid(totals.sparkSession, "floor", list(floors)))
    rows = grid.join(totals, F.col("n") >= F.col("floor")).select("floor", "n", "failed")
    base = rows.groupBy("floor").agg((F.sum("failed") / F.sum("n")).alias("b"))
    e = F.col("n") * F.col("b")
    out = rows.join(F.broadcast(base), "floor").groupBy("floor").agg(F.sum(F.when(e > 0, F.pow(F.col("failed") - e, 2) / e)).alias("x"), (F.count(F.lit(1)) - 1).alias("degrees"))
    # rounded twice: the order of a sum of doubles must not decide a half
    kept = lambda c: F.round(F.round(c, 8), 4)
    return out.select("floor", "degrees", kept(F.col("x")).alias("chi_square"), kept(F.col("x") / F.nullif(F.col("degrees"), F.lit(0))).alias("dispersion"))


def shared_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys with more than one owner."""
    return df.groupBy(key).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")
