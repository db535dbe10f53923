"""A suite of declared checks, compiled to one scan per table, one grouping per unique key and one join per parent.

Each check is a line; what runs follows from the tables, not from the number of checks: all column checks of a table are
aggregates of one pass, and the children of a parent key go through one join together. The result is a row per check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, WARN = "error", "warn"


@dataclass(frozen=True)
class Check:
    """kind: not_null, between (low, high), accepted (values), holds (an SQL condition, broken where it is false), unique, or refers (parent table, its column).

    columns: what is checked; name: of the check, made from the rest if empty.
    """

    table: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = field(default=())
    severity: str = ERROR
    name: str = ""

    def label(self) -> str:
        return self.name or f"{self.table}_{self.kind}_{'_'.join(self.columns)}"


def not_null(table: str, *columns: str, severity: str = ERROR) -> list[Check]:
    return [Check(table, "not_null", (c,), severity=severity) for c in columns]


def between(table: str, column: str, low, high, severity: str = ERROR) -> Check:
    return Check(table, "between", (column,), (low, high), severity)


def accepted(table: str, column: str, *values, severity: str = ERROR) -> Check:
    return Check(table, "accepted", (column,), values, severity)


def holds(table: str, name: str, condition: str, severity: str = ERROR) -> Check:
    return Check(table, "holds", (), (condition,), severity, f"{table}_{name}")


def unique(table: str, *columns: str, severity: str = ERROR) -> Check:
    return Check(table, "unique", columns, severity=severity)


def refers(table: str, column: str, parent: str, key: str, severity: str = ERROR) -> Check:
    return Check(table, "refers", (column,), (parent, key), severity)


def _broken(c: Check) -> Column:
    """Rows of the table that break a check of one row; nulls break not_null alone."""
    if c.kind == "not_null":
        return F.col(c.columns[0]).isNull()
    if c.kind == "between":
        return (F.col(c.columns[0]) < c.values[0]) | (F.col(c.columns[0]) > c.values[1])
    if c.kind == "accepted":
        return ~F.col(c.columns[0]).isin(*c.values)
    if c.kind == "holds":
        return ~F.expr(c.values[0])
    raise ValueError(f"unknown check: {c.kind}")


def results(suite: Sequence[Check], tables: dict[str, DataFrame]) -> DataFrame:
    """check, table, severity, failures and passed of each check (an empty table passes)."""
    names = [c.label() for c in suite]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"checks of one name: {', '.join(twice)}")
    parts: list[DataFrame] = []
    for table in dict.fromkeys(c.table for c in suite):
        own = [c for c in suite if c.table == table and c.kind not in ("unique", "refers")]
        if own:  # one pass
            counts = tables[table].agg(*(F.count_if(_broken(c)).alias(c.label()) for c in own))
            parts.append(counts.unpivot([], [c.label() for c in own], "check", "failures"))
    for c in (c for c in suite if c.kind == "unique"):
        doubled = tables[c.table].groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n"))
        parts.append(doubled.agg(F.count_if(F.col("n") > 1).alias("failures")).select(F.lit(c.label()).alias("check"), "failures"))
    for parent, key in dict.fromkeys(c.values for c in suite if c.kind == "refers"):
        children = [c for c in suite if c.kind == "refers" and c.values == (parent, key)]
        kind = tables[parent].schema[key].dataType
        keys = [tables[c.table].select(F.lit(c.label()).alias("check"), F.col(c.columns[0]).cast(kind).alias("_key")).where("_key IS NOT NULL") for c in children]
        # a key's rows are counted before they move; an outer join, as an anti-join would be split up by child again
        counted = reduce(DataFrame.unionByName, keys).groupBy("check", "_key").agg(F.count(F.lit(1)).alias("n"))
        known = tables[parent].select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
        lost = counted.join(known, "_key", "left").where("_known IS NULL")
        parts.append(lost.groupBy("check").agg(F.sum("n").alias("failures")))
    spark = next(iter(tables.values())).sparkSession
    declared = spark.createDataFrame([(c.label(), c.table, c.severity) for c in suite], "check string, table string, severity string")
    found = reduce(DataFrame.unionByName, [p.select("check", F.col("failures").cast("long").alias("failures")) for p in parts])
    out = declared.join(F.broadcast(found), "check", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))  # a row per check
    return out.withColumn("passed", F.col("failures") == 0)


def gate(found: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the errors and of the warnings that did not pass."""
    rows = found.where("NOT passed").select("check", "severity").orderBy("check").collect()
    return [r["check"] for r in rows if r["severity"] == ERROR], [r["check"] for r in rows if r["severity"] != ERROR]


def unusual(history: DataFrame, days: int = 30, ratio: float = 0.3, least: int = 5) -> DataFrame:
    """Results (check, day, failures) that lie more than a ratio away from the check's mean over the periods before, where there are enough of these."""
    w = Window.partitionBy("check").orderBy("day").rowsBetween(-days, -1)
    rows = history.withColumns({"usual": F.round(F.avg("failures").over(w), 4), "_n": F.count("failures").over(w)})
    return rows.where((F.col("_n") >= least) & (F.abs(F.col("failures") - F.col("usual")) > ratio * F.col("usual"))).drop("_n")
