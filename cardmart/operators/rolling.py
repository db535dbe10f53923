"""Trailing windows over calendar days.

Series are kept as steps: intervals of days [day, until) over which a value stays the same. An event on day d
counts from d until d + days, so it is +x on d and -x on d + days, and a cumulative sum gives the window's
value. The work follows the events, not entities times days; days are written out only where a report needs
each of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(bounds: DataFrame, first: str = "first_day", last: str = "last_day", name: str = "day") -> DataFrame:
    """A row per day of each row's range."""
    return bounds.where(F.col(first) <= F.col(last)).withColumn(name, F.explode(F.sequence(first, last)))


def densified(days: DataFrame, facts: DataFrame, on: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """Facts on every row of the spine, measures zero where there is none."""
    return days.join(facts, list(on), "left").fillna(0, subset=list(zero))


def trailing_rows(df: DataFrame, by: Sequence[str], day: str, sums: dict[str, str], days: int) -> DataFrame:
    """Row-framed trailing sums over a dense series."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(1 - days, 0)
    return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})


def dealt(df: DataFrame, by: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Rows dealt out by key, to a number of parts where the caller knows what the rows call for."""
    return df.repartition(parts, *by) if parts else df.repartition(*by)


def steps_from_deltas(deltas: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Steps of cumulative sums; deltas: the keys, day and the change of each measure on it."""
    w = Window.partitionBy(*by).orderBy("day")
    summed = deltas.groupBy(*by, "day").agg(*(F.sum(n).alias(n) for n in names))
    return summed.select(*by, "day", F.lead("day").over(w).alias("until"), *(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))


def sum_deltas(daily: DataFrame, by: Sequence[str], sums: Sequence[str], days: int, others: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Changes of trailing sums. daily: keys, day, measures and other columns to keep. Days are dealt out by key before they are doubled, so steps_from_deltas() moves them no more."""
    sign = F.explode(F.array(F.struct(F.lit(0).alias("shift"), F.lit(1).alias("sign")), F.struct(F.lit(days).alias("shift"), F.lit(-1).alias("sign"))))
    return dealt(daily, by, parts).withColumn("_d", sign).select(*by, *others, F.date_add("day", F.col("_d.shift")).alias("day"), *((F.col(c) * F.col("_d.sign")).alias(c) for c in sums))


def distinct_deltas(daily: DataFrame, by: Sequence[str], item: str, days: int, name: str) -> DataFrame:
    """Changes of the number of distinct items in a trailing window: an item counts until days have passed without it."""
    w = Window.partitionBy(*by, item).orderBy("day")
    seen = daily.select(*by, item, "day").distinct().withColumn("_next", F.lead("day").over(w))
    until = F.least(F.date_add("day", days), F.coalesce("_next", F.date_add("day", days)))
    ends = F.explode(F.array(F.struct(F.col("day").alias("d"), F.lit(1).alias("n")), F.struct(until.alias("d"), F.lit(-1).alias("n"))))
    return seen.withColumn("_e", ends).select(*by, F.col("_e.d").alias("day"), F.col("_e.n").alias(name))


def meeting(steps: DataFrame, ranges: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Steps cut to the ranges that they meet, with the ranges' other columns (open ends are null). Ranges of a key do not overlap."""
    r = ranges.withColumnsRenamed({"day": "_from", "until": "_to"})
    meets = (F.coalesce(F.col("_to") > F.col("day"), F.lit(True))) & (F.coalesce(F.col("until") > F.col("_from"), F.lit(True)))
    same = [F.col(f"s.{c}") == F.col(f"r.{c}") for c in on]
    joined = steps.alias("s").join(r.alias("r"), [*same, meets], how)
    others = [F.col(f"r.{c}") for c in r.columns if c not in (*on, "_from", "_to")]
    kept = [F.col(f"s.{c}") for c in steps.columns if c not in ("day", "until")]
    return joined.select(*kept, F.greatest("day", "_from").alias("day"), F.least("until", "_to").alias("until"), *others)


def written_out(steps: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A row per day of each step, within the bounds; open steps last until the end."""
    a = F.greatest("day", F.lit(start))
    b = F.least(F.coalesce(F.date_sub("until", 1), F.lit(end)), F.lit(end))
    return steps.withColumns({"_a": a, "_b": b}).where("_a <= _b").withColumn("day", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "until")


def window_days(day, start: dt.date, days: int):
    """Length of a trailing window that the start of history cuts short."""
    return (F.datediff(day, F.greatest(F.date_sub(day, days - 1), F.lit(start))) + 1).cast("int")


def bounds(df: DataFrame, day: str = "day") -> tuple[dt.date, dt.date]:
    first, last = df.agg(F.min(day), F.max(day)).first()
    if first is None:
        raise ValueError("no dated rows")
    return first, last
