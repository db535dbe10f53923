"""Trailing rules over a stream, exact: the transactions that the batch rules name, each once.

A window of a batch rule ends with a transaction, not on a grid of minutes, and counts what happened before it, whenever it arrives. So a key's
transactions wait in its state until the watermark has passed them (nothing earlier can come then); a timer on the earliest of them
decides all that are due, in order of event time, and drops what no later window reaches. State and work of a key follow
its transactions within the window and the allowed lateness. The streams need the RocksDB state store.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Trailing(StatefulProcessor):
    """State of a key: its transactions as (time in microseconds, whether decided, item, carried columns)."""

    def __init__(self, schema: T.StructType, key: str, carried: Sequence[str], most: int, span: int, distinct: bool):
        self.schema, self.key, self.carried, self.most, self.span, self.distinct = schema, key, list(carried), most, span, distinct

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.schema)

    def _wake(self, micros: int) -> None:
        """One timer a key, for its earliest transaction that is not decided."""
        due = micros // 1000 + 1
        known = list(self.handle.listTimers())
        if known and min(known) <= due:
            return
        for t in known:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for df in rows:
            columns = [df["event_micros"].tolist(), [False] * len(df), df["event_item"].tolist(), *(df[c].astype(object).where(df[c].notna(), None).tolist() for c in self.carried)]
            new += zip(*columns, strict=True)
        if new:
            self.events.appendList(new)
            self._wake(min(e[0] for e in new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(map(tuple, self.events.get()), key=lambda e: e[0])
        times = [e[0] for e in events]
        hits, kept = [], []
        for e in events:
            if not e[1] and e[0] <= passed:
                inside = events[bisect_left(times, e[0] - self.span) : bisect_right(times, e[0])]
                n = len({x[2] for x in inside} - {None}) if self.distinct else len(inside)
                if n > self.most:
                    hits.append((*key, *e[3:], pd.Timestamp(e[0], unit="us"), n))
                e = (e[0], True, *e[2:])
            if e[0] >= passed - self.span:
                kept.append(e)
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        waiting = [e[0] for e in kept if not e[1]]
        if waiting:
            self._wake(min(waiting))
        yield pd.DataFrame(hits, columns=[self.key, *self.carried, "ts", "n"]) if hits else pd.DataFrame()

    def close(self) -> None:
        pass


def _trailing(stream: DataFrame, key: str, item: str | None, most: int, minutes: int, late: str) -> DataFrame:
    carried = [c for c in stream.columns if c not in (key, "ts")]
    types = {f.name: f.dataType for f in stream.schema}
    state = T.StructType([T.StructField("us", T.LongType()), T.StructField("told", T.BooleanType()), T.StructField("item", T.StringType()), *(T.StructField(c, types[c]) for c in carried)])
    out = T.StructType([T.StructField(key, types[key]), *(T.StructField(c, types[c]) for c in carried), T.StructField("ts", T.TimestampType()), T.StructField("n", T.IntegerType())])
    named = F.col(item).cast("string") if item else F.lit(None).cast("string")
    rows = stream.withWatermark("ts", late).withColumns({"event_micros": F.unix_micros("ts"), "event_item": named})
    found = rows.groupBy(key).transformWithStateInPandas(_Trailing(state, key, carried, most, minutes * 60_000_000, item is not None), out, "Append", "EventTime", eventTimeColumnName="ts")
    return found


def velocity(stream: DataFrame, key: str, most: int, minutes: int, late: str = "10 minutes") -> DataFrame:
    """VR001, VR002: transactions at which a key has more than `most` within the last minutes. Twin: rules.velocity()."""
    return _trailing(stream, key, None, most, minutes, late)


def spread(stream: DataFrame, key: str, item: str, most: int, minutes: int, late: str = "10 minutes") -> DataFrame:
    """VR003, GR001: transactions at which a key has met more than `most` different items within the last minutes. Twin: rules.spread()."""
    return _trailing(stream, key, item, most, minutes, late)
