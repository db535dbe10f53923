"""Readers: raw text stays text, absent targets are empty."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _joined(base: str, rel: str) -> str:
    if not rel or not rel.strip():
        raise ValueError("a path is needed")
    return f"{base.rstrip('/')}/{rel.lstrip('/')}"


def read_csv(spark: SparkSession, base: str, rel: str, *, header: bool = True, infer_schema: bool = False, delimiter: str = ",") -> DataFrame:
    return spark.read.csv(_joined(base, rel), header=header, inferSchema=infer_schema, sep=delimiter)


def read_json(spark: SparkSession, base: str, rel: str, **options: object) -> DataFrame:
    return spark.read.options(**options).json(_joined(base, rel))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table_or_path(spark: SparkSession, name: str) -> DataFrame:
    if "/" not in name and spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.parquet(name)


def read_target(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parquet target, or an empty frame of the schema where there is none yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def days(spark: SparkSession, start: dt.date, end: dt.date, name: str = "full_date") -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias(name))


def seconds_of_day(spark: SparkSession, name: str = "second_of_day") -> DataFrame:
    return spark.range(86_400).withColumnRenamed("id", name)


def parameter_grid(spark: SparkSession, name: str, values: list) -> DataFrame:
    """A small literal relation of one column."""
    return spark.createDataFrame([(v,) for v in values], [name])


def checked_codes(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Distinct upper-case codes of a column; ValueError names those that are not known."""
    codes = df.select(F.upper(F.trim(F.col(column))).alias("code")).where("code is not null").distinct()
    bad = [r.code for r in codes.where(~F.col("code").isin(*known)).orderBy("code").limit(20).collect()]
    if bad:
        raise ValueError(f"unsupported codes: {', '.join(bad)}")
    return codes.orderBy("code")


def _nth(month: int, weekday: int, n: int, year: Column) -> Column:
    """The n-th weekday (0: Monday) of a month, from its end where n is negative."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)).cast("int") + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)).cast("int") + 7 * (-n - 1))


def us_holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """full_date and holiday_name of the federal holidays; one on a weekend is observed on the nearest weekday too.

    A New Year's Day on a Saturday is observed in the year before, also where its own year is not asked for.
    """
    y = F.col(year)
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = {
        "New Year's Day": fixed(1, 1), "Martin Luther King Jr. Day": _nth(1, 0, 3, y), "Washington's Birthday": _nth(2, 0, 3, y), "Memorial Day": _nth(5, 0, -1, y),
        "Juneteenth National Independence Day": F.when(y >= 2021, fixed(6, 19)), "Independence Day": fixed(7, 4), "Labor Day": _nth(9, 0, 1, y), "Columbus Day": _nth(10, 0, 2, y),
        "Veterans Day": fixed(11, 11), "Thanksgiving Day": _nth(11, 3, 4, y), "Christmas Day": fixed(12, 25),
    }
    named = [*rules.items(), ("New Year's Day", F.make_date(y + 1, F.lit(1), F.lit(1)))]
    every = F.explode(F.array(*(F.struct(d.alias("full_date"), F.lit(n).alias("holiday_name")) for n, d in named)))
    rows = years.select(y).distinct().select(y.alias("_y"), every.alias("h")).select("_y", "h.*").where("full_date is not null")
    shift = F.when(F.dayofweek("full_date") == 7, -1).when(F.dayofweek("full_date") == 1, 1)
    observed = rows.where(shift.isNotNull()).select("_y", F.date_add("full_date", shift).alias("full_date"), F.concat("holiday_name", F.lit(" (observed)")).alias("holiday_name"))
    return rows.unionByName(observed).where(F.year("full_date") == F.col("_y")).groupBy("full_date").agg(F.min("holiday_name").alias("holiday_name"))
