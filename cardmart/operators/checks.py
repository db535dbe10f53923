"""Data-quality checks: each returns the violations; metrics of one table are taken in one pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def metrics(df: DataFrame, required: Sequence[str] = (), ranges: dict[str, tuple] | None = None, accepted: dict[str, Sequence] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """One row: row count and violations of every not-null, range, accepted-values and row rule."""
    out = [F.count(F.lit(1)).alias("row_count")]
    out += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    out += [F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"range_{c}") for c, (low, high) in (ranges or {}).items()]
    out += [F.count_if(~F.col(c).isin(*v)).alias(f"accepted_{c}") for c, v in (accepted or {}).items()]
    out += [F.count_if(~r).alias(f"rule_{n}") for n, r in (rules or {}).items()]
    return df.agg(*out)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def reconciled(source: DataFrame, target: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Keys on which two frames of sums differ; a side without the key counts as zero, so a missing partition shows."""
    a = source.select(*keys, *(F.col(m).cast("double").alias(f"source_{m}") for m in measures))
    b = target.select(*keys, *(F.col(m).cast("double").alias(f"target_{m}") for m in measures))
    both = a.join(b, list(keys), "full").fillna(0.0, subset=[*(f"source_{m}" for m in measures), *(f"target_{m}" for m in measures)])
    return both.where(reduce(lambda x, y: x | y, (F.abs(F.col(f"source_{m}") - F.col(f"target_{m}")) > tolerance for m in measures)))


def reconciled_amounts(source: DataFrame, target: DataFrame, keys: Sequence[str], amount: str, tolerance: str = "0.00") -> DataFrame:
    """Keys on which exact sums differ: both sums and the difference, as decimals; a side without the key counts as zero."""
    total = lambda d, n: d.groupBy(*keys).agg(F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(28,2)").alias(n))
    zero = F.lit("0.00").cast("decimal(28,2)")
    both = total(source, "source_amount").join(total(target, "target_amount"), list(keys), "full").withColumns({c: F.coalesce(c, zero) for c in ("source_amount", "target_amount")})
    return both.withColumn("difference", F.col("source_amount") - F.col("target_amount")).where(F.abs("difference") > F.lit(tolerance).cast("decimal(28,2)"))


def bridge_gaps(fact: DataFrame, bridge: DataFrame, key: str, flagged: str) -> DataFrame:
    """Both ways: bridge rows without a fact, and flagged facts without a bridge row."""
    lost = bridge.select(key).distinct().join(fact.select(key), key, "left_anti").withColumn("gap", F.lit("no fact"))
    bare = fact.where(flagged).select(key).join(bridge.select(key).distinct(), key, "left_anti").withColumn("gap", F.lit("no bridge"))
    return lost.unionByName(bare)


def not_current(bridge: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of a bridge whose key is not that of a current version."""
    return bridge.join(dim.where("is_current").select(key).distinct(), key, "left_anti")


def incomplete(report: DataFrame, first: dt.date, days: int, column: str = "window_day_count", day: str = "date_key") -> DataFrame:
    """Rows whose window is not whole although the history is long enough on their day (day: a date or a yyyymmdd key)."""
    on = F.col(day) if dict(report.dtypes)[day] == "date" else F.to_date(F.col(day).cast("string"), "yyyyMMdd")
    return report.where((on >= F.lit(first + dt.timedelta(days=days - 1))) & (F.col(column) != days))


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have all their keys."""
    return df.dropna(subset=list(keys))


def unpivoted(df: DataFrame, name: str = "key", value: str = "value") -> DataFrame:
    """The columns of a wide object as rows of name and value (as text); columns without a value are left out."""
    text = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    return text.unpivot([], text.columns, name, value).where(F.col(value).isNotNull())


def band(df: DataFrame, day: str, hit: Column, low: float, high: float) -> DataFrame:
    """Days on which the share of hits leaves a band."""
    share = F.round(F.count_if(hit) / F.count(F.lit(1)), 6)
    return df.groupBy(day).agg(share.alias("share")).where((F.col("share") < low) | (F.col("share") > high))


def share_over(df: DataFrame, by: Sequence[str], part: Column, whole: Column, percent: int) -> DataFrame:
    """Groups in which part is at least percent of whole, in whole numbers."""
    return df.groupBy(*by).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole")).where(F.col("part") * 100 >= F.col("whole") * percent)


def not_uniform(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.countDistinct(column).alias("n")).where("n <> 1")


def fingerprint(df: DataFrame, part: str, measures: Sequence[str]) -> DataFrame:
    """Row count, sums and extremes of each partition, to compare two runs. Decimals are summed as such, so that the order of rows does not matter."""
    sums = [F.sum(F.col(m)).cast("double").alias(f"sum_{m}") for m in measures]
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("row_count"), *sums, *(F.min(F.col(m).cast("double")).alias(f"min_{m}") for m in measures), *(F.max(F.col(m).cast("double")).alias(f"max_{m}") for m in measures))


def anomalies(df: DataFrame, day: str, value: str, days: int = 30, ratio: float = 0.3) -> DataFrame:
    """Periods whose value is more than ratio away from the mean of the days before."""
    from pyspark.sql import Window

    w = Window.orderBy(day).rowsBetween(-days, -1)  # one row per day
    v = F.col(value).cast("double")
    return df.withColumn("usual", F.round(F.avg(v).over(w), 4)).where(F.abs(v - F.col("usual")) > ratio * F.col("usual")).select(day, v.alias(value), "usual")


def coverage(df: DataFrame, columns: Sequence[str], unknown: Sequence[str] = ("-1",)) -> DataFrame:
    """Share of rows whose key is resolved, per column."""
    ok = [F.round(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*unknown)) / F.count(F.lit(1)), 6).alias(c) for c in columns]
    return df.agg(*ok)


def split_mandatory(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all mandatory columns, and the others with the reason and the names of the null ones."""
    if not columns:
        return df, df.limit(0).withColumns({"_quarantine_reason": F.lit(""), "_quarantine_null_cols": F.lit("")})
    any_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    names = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return df.where(~any_null), df.where(any_null).withColumns({"_quarantine_reason": F.lit("null_mandatory_column"), "_quarantine_null_cols": names})


def stringified(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*(c if c in keep else F.col(c).cast("string").alias(c) for c in df.columns))


def schema_problems(df: DataFrame, expected: dict[str, str]) -> list[str]:
    have = dict(df.dtypes)
    return [f"missing {c}" for c in expected if c not in have] + [f"{c} is {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]


def coerced(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """The contract's columns: missing ones null, others cast where they can be."""
    return df.select(*((F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in expected.items()))


def first_column(df: DataFrame, names: Sequence[str], required: bool = False) -> Column:
    """The first of several columns that is there, else null or an error."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    if required:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.lit(None)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def freshness(df: DataFrame, ts: str, now: dt.datetime, minutes: int) -> DataFrame:
    """One row where the newest row is older than so many minutes, or there is none."""
    lag = F.timestamp_diff("MINUTE", F.max(ts), F.lit(now).cast("timestamp_ntz"))
    return df.agg(lag.alias("lag_minutes")).where((F.col("lag_minutes") > minutes) | F.col("lag_minutes").isNull())


def row_loss(source: int, target: int, percent: float) -> str | None:
    if target > source:
        return f"{target} rows from {source}"
    return f"{100 * (source - target) / source:.2f} % of rows lost" if source and 100 * (source - target) / source > percent else None


def within(a: float, b: float, absolute: float = 0.0, percent: float = 0.0) -> bool:
    return abs(a - b) <= max(absolute, abs(a) * percent / 100)


def check_window(start: dt.datetime, end: dt.datetime, minutes: int) -> None:
    if not start < end or end - start > dt.timedelta(minutes=minutes):
        raise ValueError(f"a window of at most {minutes} minutes is needed: {start} to {end}")
