"""Trailing windows as a kept state that moves a day at a time.

The state of a day holds, per entity, the sums over its trailing window and the day on which it was last seen; and, per
entity and distinct item, the last day of the item. Moving on by a day adds the entering day and takes the leaving one
away: an item leaves when its last day does. So a day's report reads two days of facts and a state of the size of its entities, however
long the history and the window are.

The state is a folder per day and part (totals, items), so a day that runs again starts from the same state of the day before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists
from .sinks import overwrite


@dataclass(frozen=True)
class TrailingState:
    """What a state keeps.

    by: the columns that name an entity; sums: measures, columns of the facts; item: a column whose distinct values are counted (null ones are not), as
    `name`; days: length of the window. Facts have a column day.
    """

    by: Sequence[str]
    sums: Sequence[str]
    days: int
    item: str | None = None
    name: str = "items"

    def _items(self, facts: DataFrame) -> DataFrame:
        return facts.where(F.col(self.item).isNotNull()).groupBy(*self.by, self.item).agg(F.max("day").alias("last"))

    def _totals(self, facts: DataFrame) -> DataFrame:
        return facts.groupBy(*self.by).agg(*(F.sum(c).alias(c) for c in self.sums), F.max("day").alias("last_day"))

    def build(self, facts: DataFrame, day: dt.date) -> tuple[DataFrame, DataFrame | None]:
        """The state of a day (totals, items) from all facts up to it."""
        past = facts.where(F.col("day") <= F.lit(day))
        inside = F.col("day") > F.lit(day - dt.timedelta(days=self.days))
        totals = past.groupBy(*self.by).agg(*(F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c) for c in self.sums), F.max("day").alias("last_day"))
        if not self.item:
            return totals, None
        items = self._items(past.where(inside))
        return self._counted(totals, items.groupBy(*self.by).agg(F.count(F.lit(1)).alias(self.name))), items

    def _counted(self, totals: DataFrame, counts: DataFrame) -> DataFrame:
        return totals.join(counts, list(self.by), "left").fillna(0, subset=[self.name])

    def advance(self, totals: DataFrame, items: DataFrame | None, facts: DataFrame, day: dt.date) -> tuple[DataFrame, DataFrame | None]:
        """The state of a day from that of the day before. Of facts only the entering and the leaving day are read, as literal predicates."""
        by = list(self.by)
        gone = day - dt.timedelta(days=self.days)
        entering, leaving = (facts.where(F.col("day") == F.lit(d)) for d in (day, gone))
        # all three are a row per entity; their sum is the new state
        parts = [totals, self._totals(entering)]
        minus = self._totals(leaving)
        parts.append(minus.select(*by, *((-F.col(c)).alias(c) for c in self.sums), F.lit(None).cast("date").alias("last_day")))
        if self.item:
            come = self._items(entering)
            both = items.select(*by, self.item, F.col("last").alias("old")).join(come, [*by, self.item], "full")
            both = both.select(*by, self.item, "old", F.coalesce("last", "old").alias("last"))
            change = F.when(F.col("old").isNull(), 1).when(F.col("last") <= F.lit(gone), -1)
            counts = both.select(*by, change.alias(self.name)).where(F.col(self.name).isNotNull()).groupBy(*by).agg(F.sum(self.name).alias(self.name))
            parts.append(counts)
            items = both.where(F.col("last") > F.lit(gone)).select(*by, self.item, "last")
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p, allowMissingColumns=True)
        types = dict(totals.dtypes)
        measures = [*self.sums, *([self.name] if self.item else [])]
        out = merged.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(types[c]).alias(c) for c in measures), F.max("last_day").alias("last_day"))
        return out, items


class KeptState:
    """A TrailingState under a path, day by day."""

    def __init__(self, what: TrailingState, path: str):
        self.what, self.path = what, path.rstrip("/")

    def _folder(self, day: dt.date, part: str) -> str:
        return f"{self.path}/{part}/day={day}"

    def of(self, spark: SparkSession, day: dt.date) -> tuple[DataFrame, DataFrame | None]:
        """The kept state of a day."""
        return spark.read.parquet(self._folder(day, "totals")), spark.read.parquet(self._folder(day, "items")) if self.what.item else None

    def has(self, spark: SparkSession, day: dt.date) -> bool:
        """Whether the day's state is whole; totals are written last."""
        return path_exists(spark, f"{self._folder(day, 'totals')}/_SUCCESS")

    def _keep(self, state: tuple[DataFrame, DataFrame | None], day: dt.date) -> None:
        if state[1] is not None:
            overwrite(state[1], self._folder(day, "items"))
        overwrite(state[0], self._folder(day, "totals"))

    def build(self, facts: DataFrame, day: dt.date) -> None:
        self._keep(self.what.build(facts, day), day)

    def roll(self, facts: DataFrame, day: dt.date) -> DataFrame:
        """Keep the day's state, made from that of the day before, and return its totals. A day that ran before is made anew."""
        spark, before = facts.sparkSession, day - dt.timedelta(days=1)
        if not self.has(spark, before):
            raise ValueError(f"no state of {before} at {self.path}")
        self._keep(self.what.advance(*self.of(spark, before), facts, day), day)
        return self.of(spark, day)[0]
