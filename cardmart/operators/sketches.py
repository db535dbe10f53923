"""Mergeable sketches of distinct counts and quantiles: per day and segment once, then merged for any window and roll-up.

Distinct counts and quantiles of days do not add up (marts.safe_rollup refuses them); their sketches do. A distinct sketch (HLL) of merged days is the same by
whatever steps it was merged, and it and a quantile sketch (KLL) of merged days have the error bound of one over all rows. The exact forms stay where they are: this is for roll-ups
over many days, where the exact ones read the rows again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch (relative standard error 1.04 / sqrt(2^LOG), 0.8 % here), size of a quantile sketch, and the rank error that it keeps
#: with a probability of 99 %.
LOG, SIZE, RANK_ERROR = 14, 400, 0.009


def daily(df: DataFrame, by: Sequence[str], distinct: Sequence[str], values: Sequence[str], day: str = "day") -> DataFrame:
    """A row per day and segment: n, a sketch of each distinct column and of each column of values (nulls left out)."""
    sets = [F.hll_sketch_agg(c, F.lit(LOG)).alias(f"{c}_set") for c in distinct]
    return df.groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"), *sets, *(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SIZE)).alias(f"{c}_values") for c in values))


def merged(sketches: DataFrame, by: Sequence[str], distinct: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups: fewer columns in by, or a longer period in one of them."""
    sets = [F.hll_union_agg(f"{c}_set").alias(f"{c}_set") for c in distinct]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *sets, *(F.kll_merge_agg_double(f"{c}_values", F.lit(SIZE)).alias(f"{c}_values") for c in values))


def trailing(sketches: DataFrame, by: Sequence[str], distinct: Sequence[str], values: Sequence[str], days: Sequence[dt.date], window: int, day: str = "day") -> DataFrame:
    """Merged sketches of the trailing window of each of these days."""
    ends = F.filter(F.array(*map(F.lit, days)), lambda d: (F.col(day) <= d) & (F.col(day) > F.date_sub(d, window)))
    return merged(sketches.withColumn("window_end", F.explode(ends)), ["window_end", *by], distinct, values)


def estimated(sketches: DataFrame, by: Sequence[str], distinct: Sequence[str], quantiles: dict[str, Sequence[float]]) -> DataFrame:
    """Distinct counts (unique_<column>) and quantiles (<column>_p<per cent>) of sketches."""
    counts = [F.hll_sketch_estimate(f"{c}_set").alias(f"unique_{c}") for c in distinct]
    return sketches.select(*by, "n", *counts, *(quantile(c, q).alias(f"{c}_p{round(100 * q)}") for c, qs in quantiles.items() for q in qs))


def quantile(column: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(f"{column}_values", F.lit(float(q)))


def rank(column: str, value: Column) -> Column:
    """The share of values up to this one."""
    return F.kll_sketch_get_rank_double(f"{column}_values", value.cast("double"))
