"""Dimensions, facts and reports of the card mart."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..sources import readers
from . import rolling, scd2
from .sinks import written
from .window_state import TrailingState

SENTINELS = ("-1", "-2")
#: Report parameters: trailing days, least transactions, rate above which a merchant is abnormal.
ACTIVE_DAYS, ERROR_DAYS = 90, 30


def dim_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    d = readers.days(spark, start, end)
    d = d.withColumns(clean.calendar_parts(F.col("full_date")))
    holidays = readers.us_holidays(d.select("year"))
    return d.join(F.broadcast(holidays), "full_date", "left").withColumn("is_holiday", F.col("holiday_name").isNotNull())


def dim_time(spark: SparkSession) -> DataFrame:
    s = readers.seconds_of_day(spark)
    return s.select(*(c.alias(n) for n, c in clean.clock_parts(F.col("second_of_day")).items()))


def dim_geo(places: Sequence[DataFrame]) -> DataFrame:
    """location_key of each distinct city, state and zip of all sources, with the unknown members."""
    every = reduce(DataFrame.unionByName, places).select(*(clean.upper_trim(F.col(c)).alias(c) for c in ("city", "state")), clean.blank_to(F.col("zip"), "UNKNOWN").alias("zip"))
    every = every.where("nullif(city, '') is not null and nullif(state, '') is not null").distinct()
    rows = every.select(clean.sha_key(F.col("city"), F.col("state"), F.col("zip")).alias("location_key"), "city", "state", "zip")
    extra = every.sparkSession.createDataFrame([("-1", "UNKNOWN", "UNKNOWN", "UNKNOWN"), ("-2", "NOT APPLICABLE", "NOT APPLICABLE", "NOT APPLICABLE")], rows.schema)
    return rows.unionByName(extra)


def dim_category(codes: DataFrame) -> DataFrame:
    """mcc and its name, with the unknown members."""
    rows = codes.where("mcc is not null").select("mcc", clean.blank_to(F.col("name"), "UNKNOWN").alias("merchant_category_name")).distinct()
    return rows.unionByName(rows.sparkSession.createDataFrame([("-1", "UNKNOWN"), ("-2", "NOT APPLICABLE")], rows.schema))


def reference_codes(df: DataFrame, column: str, name: str, key: Callable[[Column], Column] = clean.short_key) -> DataFrame:
    """Distinct values of a column with short keys; a null or empty list of codes is key 0."""
    codes = df.select(F.explode_outer(column).alias(name)) if dict(df.dtypes)[column].startswith("array") else df.select(F.col(column).alias(name))
    codes = codes.select(F.coalesce(clean.blank_to_null(F.col(name)), F.lit("No Error")).alias(name)).distinct()
    return codes.withColumn(f"{name}_key", F.when(F.col(name) == "No Error", F.lit(0).cast("short")).otherwise(key(F.col(name))))


def fact_transactions(txn: DataFrame, customers: DataFrame, cards: DataFrame, resolve: str = "as_of") -> DataFrame:
    """Transactions with the keys of the versions that held at their time, or of the current ones (null where there is none)."""
    ts = F.col("ts")
    if resolve == "as_of":
        out = scd2.as_of(txn, customers, "customer_id", "customer_id", ts, {"customer_key": "customer_key", "birth_year": "birth_year"})
        out = scd2.as_of(out, cards, "card_id", "card_id", ts, {"card_key": "card_key"})
    elif resolve == "current":
        norm = lambda c: F.upper(clean.blank_to_null(F.col(c)))
        c = customers.where("is_current").select(norm("customer_id").alias("_c"), "customer_key", "birth_year")
        d = cards.where("is_current").select(norm("card_id").alias("_d"), "card_key")
        out = txn.join(c, norm("customer_id") == F.col("_c"), "left").join(d, norm("card_id") == F.col("_d"), "left").drop("_c", "_d")
    else:
        raise ValueError(f"unknown way to resolve versions: {resolve}")
    return out.withColumn("customer_age_at_transaction", clean.age_at(ts, F.col("birth_year"))).drop("birth_year")


def normalised(c: Column) -> Column:
    """A join key as text: trimmed, in capitals, null where nothing is left."""
    return F.upper(clean.blank_to_null(c.cast("string")))


@dataclass(frozen=True)
class Lookup:
    """A dimension, the columns of the fact and of the dimension that have to agree, and the key that the fact gets."""

    dim: DataFrame
    fact_columns: Sequence[str]
    dim_columns: Sequence[str]
    key: str


def star(rows: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Rows with the key of each dimension by normalised columns; null where there is none. A dimension with a version flag counts with its current versions only.

    Of several entries of a dimension with the same normalised columns the least key counts, so no row is multiplied.
    """
    out = rows
    for n, x in enumerate(lookups):
        names = [f"_{n}_{k}" for k in range(len(x.dim_columns))]
        dim = x.dim.where("is_current") if "is_current" in x.dim.columns else x.dim
        dim = dim.select(*(normalised(F.col(c)).alias(m) for c, m in zip(x.dim_columns, names, strict=True)), F.col(x.key).alias(f"_{n}_key"))
        dim = dim.dropna(subset=names).groupBy(*names).agg(F.min(f"_{n}_key").alias(f"_{n}_key"))
        same = [normalised(F.col(c)) == F.col(m) for c, m in zip(x.fact_columns, names, strict=True)]
        out = out.join(dim, same, "left").withColumn(x.key, F.col(f"_{n}_key")).drop(*names, f"_{n}_key")
    return out


def legacy_fact(txn: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """The fact with the keys of all its dimensions as they are now, nulls kept; of several errors of a transaction the first counts.

    txn: transaction_id, ts, amount, zip, errors, and the columns of the lookups (first_error for the errors).
    """
    rows = txn.withColumns({"date_key": clean.date_key(F.col("ts")), "time_key": clean.time_key(F.col("ts")), "first_error": F.coalesce(F.get("errors", F.lit(0)), F.lit("No Error"))})
    return star(rows, lookups).select("transaction_id", "date_key", "time_key", *(x.key for x in lookups), F.col("amount").alias("transaction_amount"), F.col("zip").alias("zip_code"))


def complete_fact(txn: DataFrame, customers: DataFrame, cards: DataFrame, geo: DataFrame, categories: DataFrame, dates: DataFrame, times: DataFrame) -> DataFrame:
    """Transactions with the keys of all seven dimensions: unresolved customers, cards, places and categories are -1.

    A row whose date or time has no key in its dimension is left out. txn: also merchant_city, merchant_state, zip, transaction_type.
    """
    rows = txn.withColumns({"time_key": clean.time_key(F.col("ts")), "_city": clean.upper_trim(F.col("merchant_city")), "_state": clean.upper_trim(F.col("merchant_state")), "_zip": clean.blank_to(F.col("zip"), "UNKNOWN")})
    rows = rows.join(dates.select("date_key"), "date_key", "left_semi").join(times.select("time_key"), "time_key", "left_semi")
    place = geo.select(F.col("city").alias("_city"), F.col("state").alias("_state"), F.col("zip").alias("_zip"), F.col("location_key").alias("merchant_geo_key"))
    kinds = categories.select(F.col("mcc").alias("_mcc"))
    rows = rows.join(place, ["_city", "_state", "_zip"], "left").join(kinds, F.col("mcc") == F.col("_mcc"), "left")
    rows = rows.withColumns({"merchant_geo_key": F.coalesce("merchant_geo_key", F.lit("-1")), "mcc": F.coalesce("_mcc", F.lit("-1"))})
    return fact_transactions(rows, customers, cards).select(
        "transaction_id", "ts", "date_key", "time_key", "customer_key", "card_key", "transaction_type", "merchant_id", "merchant_geo_key", "mcc",
        F.col("amount").alias("transaction_amount"), "is_error", F.col("customer_age_at_transaction").cast("short").alias("customer_age_at_transaction"),
    )


def error_bridge(txn: DataFrame, allowed: Sequence[str], keep_unknown: bool = False) -> DataFrame:
    codes = [*allowed, *(["UNKNOWN"] if keep_unknown else [])]
    value = F.when(F.col("error_reason").isin(*allowed), F.col("error_reason")).otherwise("UNKNOWN")
    return txn.select("transaction_id", F.explode("errors").alias("error_reason")).withColumn("error_reason", value).where(F.col("error_reason").isin(*codes)).distinct()


def after_watermark(rows: DataFrame, target: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows newer than the newest row of the target, as a literal predicate."""
    newest = target.agg(F.max(ts)).first()[0]
    return rows if newest is None else rows.where(F.col(ts) > F.lit(newest))


def within(rows: DataFrame, start: dt.datetime | dt.date, end: dt.datetime | dt.date, ts: str = "ts") -> DataFrame:
    """Rows from start on and before end, as literal predicates."""
    return rows.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def trailing_window(txn: DataFrame, batch: dt.date, days: int) -> DataFrame:
    """The rows of a batch day's trailing window, as a literal range of days that reaches the scan."""
    return txn.where(F.col("day").between(F.lit(batch - dt.timedelta(days=days - 1)), F.lit(batch)))


def union_missing(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames whose columns differ; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def account_snapshot(txn: DataFrame) -> DataFrame:
    """Movements per month, account, customer and currency. txn: card_id as the account, customer_id, currency."""
    a = F.col("amount")
    return txn.groupBy(F.trunc("day", "month").alias("month"), F.col("card_id").alias("account_id"), "customer_id", "currency").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum(F.when(a > 0, a).otherwise(0)).alias("total_income_amount"), F.sum(F.when(a < 0, -a).otherwise(0)).alias("total_outcome_amount"), F.sum(a).alias("net_amount"), F.max("day").alias("last_day"),
    )


def daily_trend(txn: DataFrame, unknown: str = "-1", parts: int | None = None) -> DataFrame:
    """Sums and distinct cards and customers per day, category and merchant. Rows are dealt out once by these and sorted by card, then by customer, so that the first row of each counts: no set is held."""
    a, by = F.col("amount"), ["date_key", "mcc", "merchant_id"]
    new = lambda c: (F.col(c) != unknown) & ~F.col(c).eqNullSafe(F.lag(c).over(Window.partitionBy(*by).orderBy(c)))
    rows = rolling.dealt(txn.select(*by, "amount", "is_error", "card_id", "customer_id"), by, parts)
    return rows.withColumn("_card", new("card_id")).withColumn("_customer", new("customer_id")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(F.when(a < 0, F.abs(a)).otherwise(0)).alias("total_spend_amount"),
        F.sum(F.when(a > 0, a).otherwise(0)).alias("total_inflow_amount"),
        F.count_if(~F.col("is_error")).alias("successful_transaction_count"),
        F.count_if("is_error").alias("failed_transaction_count"),
        F.count_if("_card").alias("unique_cards"),
        F.count_if("_customer").alias("unique_customers"),
    )


def monthly_snapshot(txn: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    a, end = F.col("amount"), F.last_day("day")
    rows = txn.where(~F.col("customer_id").isin(*sentinels)).withColumn("month_end", end)
    out = rows.groupBy("month_end", "customer_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.countDistinct(F.when(F.col("card_id") != "-1", F.col("card_id"))).alias("distinct_card_count"),
        F.sum(F.when(a > 0, a).otherwise(0)).alias("total_income_amount"),
        F.sum(F.when(a < 0, -a).otherwise(0)).alias("total_outcome_amount"),
        F.count_if(~F.col("is_error")).alias("successful_transaction_count"),
    )
    n = F.dayofmonth("month_end")
    return out.withColumns({f"average_daily_total_{k}_amount": F.round(F.col(f"total_{k}_amount").cast("double") / n, 4) for k in ("income", "outcome")}).withColumn("month_end_date_key", clean.date_key(F.col("month_end"))).drop("month_end")


def trend_5min(txn: DataFrame, minutes: int = 5) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = txn.withColumns({"date_key": clean.date_key(F.col("ts")), "time_key": clean.time_bucket(second, minutes)})
    return rows.groupBy("date_key", "time_key", "merchant_id").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("total_amount"), F.count_if("is_error").alias("failed_count"), F.countDistinct("card_id").alias("unique_cards")
    )


def customer_steps(txn: DataFrame, days: int = ACTIVE_DAYS, parts: int | None = None) -> DataFrame:
    """Steps of each customer's trailing transactions and distinct cards (see rolling.distinct_deltas()), from one row per card and day; rows are dealt out by customer once."""
    known = txn.where(~F.col("customer_id").isin(*SENTINELS))
    card = F.when(~F.col("card_id").isin(*SENTINELS), F.col("card_id")).alias("card_id")
    daily = rolling.dealt(known.groupBy("customer_id", card, "day").agg(F.count(F.lit(1)).alias("n")), ["customer_id"], parts)
    following = F.lead("day").over(Window.partitionBy("customer_id", "card_id").orderBy("day"))
    gone, one, no = F.date_add("day", days), F.when(F.col("card_id").isNotNull(), 1).otherwise(0), F.lit(0)
    change = lambda day, n, cards, active: F.struct(day.alias("day"), n.cast("long").alias("n"), cards.alias("cards"), active.alias("active"))
    never = F.lit(None).cast("date")
    changes = F.array(change(F.col("day"), F.col("n"), one, F.col("day")), change(F.least(gone, F.coalesce("_next", gone)), no, -one, never), change(gone, -F.col("n"), no, never))
    deltas = daily.withColumn("_next", following).select("customer_id", F.explode(changes).alias("_c")).select("customer_id", "_c.*")
    summed = deltas.groupBy("customer_id", "day").agg(F.sum("n").alias("n"), F.sum("cards").alias("cards"), F.max("active").alias("active"))
    w = Window.partitionBy("customer_id").orderBy("day")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("customer_id", "day", F.lead("day").over(w).alias("until"), F.sum("n").over(past).alias("n"), F.sum("cards").over(past).alias("cards"), F.max("active").over(past).alias("last_day"))


def at_day_end(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """customer_key of the version that holds at the end of each row's day (-1: none)."""
    end = F.date_add("day", 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")
    return scd2.as_of(rows, dim, "customer_id", "customer_id", end, {"customer_key": "customer_key"})


def version_ranges(dim: DataFrame, key: str, surrogate: str, *others: str) -> DataFrame:
    """Ranges of days on whose end each version holds, and those between versions (surrogate and other columns null), from the first day to an open end."""
    v = dim.where(~F.col(key).isin(*SENTINELS)).select(key, surrogate, *others, F.to_date("effective_from").alias("day"), F.to_date("effective_to").alias("until")).where("day < until")
    w = Window.partitionBy(key).orderBy("day")
    v = v.withColumns({"_next": F.lead("day").over(w), "_before": F.lag("until").over(w)})
    names = (surrogate, *others)
    part = lambda held, day, until: F.struct(*((F.col(n) if held else F.lit(None).cast(dim.schema[n].dataType)).alias(n) for n in names), day.alias("day"), until.alias("until"))
    parts = F.array(
        part(True, F.col("day"), F.col("until")),
        F.when(F.col("_next").isNull() | (F.col("_next") > F.col("until")), part(False, F.col("until"), F.col("_next"))),
        F.when(F.col("_before").isNull(), part(False, F.lit("0001-01-01").cast("date"), F.col("day"))),
    )
    return v.select(key, F.explode(F.array_compact(parts)).alias("_p")).select(key, "_p.*")


def activity_totals(txn: DataFrame, customers: DataFrame, days: int = ACTIVE_DAYS, parts: int | None = None) -> DataFrame:
    """customer_activity() summed over the active customers of each day that has any; keyed: those with a version at the day's end, second: with their second one.

    The changes of steps are summed by day: no customer's days are written out.
    """
    first, last = rolling.bounds(txn)
    steps = customer_steps(txn, days, parts).where("n > 0").drop("last_day")
    rows = rolling.meeting(steps, version_ranges(customers, "customer_id", "customer_key", "version_number"), ["customer_id"], "left")
    flag = lambda c: c.cast("long")
    rows = rows.select(F.lit(1).alias("all"), F.col("day").alias("a"), F.col("until").alias("b"), F.lit(1).alias("active"), "cards", "n", flag(F.col("customer_key").isNotNull()).alias("keyed"), F.coalesce(flag(F.col("version_number") == 2), F.lit(0)).alias("second"))
    names = ["active", "cards", "n", "keyed", "second"]
    return rolling.written_out(rolling.steps_from_deltas(_range_deltas(rows, ["all"], names), ["all"], names), first, last).where("active > 0").drop("all")


def customer_activity(txn: DataFrame, batch: dt.date | None = None, days: int = ACTIVE_DAYS, customers: DataFrame | None = None, last_seen: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """A row per customer and day from the first transaction on; customers: a dimension, for the key that holds at the day's end.

    batch: that day alone, from the rows of its window; only the last day of each customer is older, and last_seen
    (customer_id, last_day up to the batch day) spares reading the history for it. state: the day's kept totals of ACTIVITY, instead of both.
    """
    key: list[str] = []
    if batch is None:
        first, last = rolling.bounds(txn)
        steps = customer_steps(txn, days)
        if customers is not None:  # a step and a version meet before days are written out: the join follows events
            steps = rolling.meeting(steps, version_ranges(customers, "customer_id", "customer_key"), ["customer_id"], "left")
            steps, customers, key = steps.withColumn("customer_key", F.coalesce("customer_key", F.lit("-1"))), None, ["customer_key"]
        rows = rolling.written_out(steps, first, last)
    elif state is not None:
        rows = state.withColumn("day", F.lit(batch))
    else:
        known = trailing_window(txn, batch, days).where(~F.col("customer_id").isin(*SENTINELS))
        seen = last_seen if last_seen is not None else txn.where(~F.col("customer_id").isin(*SENTINELS) & (F.col("day") <= F.lit(batch))).groupBy("customer_id").agg(F.max("day").alias("last_day"))
        counts = known.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(~F.col("card_id").isin(*SENTINELS), F.col("card_id"))).alias("cards"))
        rows = seen.join(counts, "customer_id", "left").fillna(0, subset=["n", "cards"]).withColumn("day", F.lit(batch))
    if customers is not None:
        rows, key = at_day_end(rows, customers), ["customer_key"]
    return rows.select(
        clean.date_key(F.col("day")).alias("date_key"), "customer_id", *key, (F.col("n") > 0).alias("is_active_90d"), F.col("cards").alias("active_card_count_90d"),
        F.col("n").alias("transaction_count_90d"), clean.date_key(F.col("last_day")).alias("last_transaction_date_key"),
    )


def version_days(dim: DataFrame) -> DataFrame:
    """Versions as half-open ranges of days on whose end they hold."""
    return dim.where(~F.col("card_id").isin(*SENTINELS)).withColumns({"v_from": F.to_date("effective_from"), "v_to": F.to_date("effective_to")})


def _range_deltas(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("d"), F.lit(1).alias("s")), F.struct(F.col("b").alias("d"), F.lit(-1).alias("s"))))
    return rows.where("a < b").withColumn("_e", ends).select(*by, F.col("_e.d").alias("day"), *((F.col(n) * F.col("_e.s")).alias(n) for n in names))


SEGMENT = ("chip_segment", "card_brand")


def issued_steps(cards: DataFrame) -> DataFrame:
    """Steps of issued cards and their reissues per segment: +1 where a version begins, -1 where it ends."""
    again = F.col("num_cards_issued") - 1
    rows = version_days(cards).select(
        clean.chip_segment(F.col("has_chip")).alias("chip_segment"), "card_brand", F.col("v_from").alias("a"), F.col("v_to").alias("b"), F.lit(1).alias("issued"),
        F.when(again == 0, 1).otherwise(0).alias("r0"), F.when(again == 1, 1).otherwise(0).alias("r1"), F.when(again >= 2, 1).otherwise(0).alias("r2"), again.alias("reissues"),
    )
    names = ["issued", "r0", "r1", "r2", "reissues"]
    return rolling.steps_from_deltas(_range_deltas(rows, SEGMENT, names), SEGMENT, names)


def _card() -> Column:
    """The card of a transaction; all unresolved ones are one."""
    return F.when(F.col("card_id").isNull() | F.col("card_id").isin(*SENTINELS), F.lit("-1")).otherwise(F.col("card_id")).alias("card_id")


def _segmented() -> list[Column]:
    """Segment of a version, and whether there is one: transactions of unresolved cards count as (UNKNOWN, UNKNOWN), without an active card."""
    return [clean.chip_segment(F.col("has_chip")).alias("chip_segment"), F.coalesce("card_brand", F.lit("UNKNOWN")).alias("card_brand"), F.when(F.col("v_from").isNotNull(), 1).otherwise(0).alias("active")]


def active_steps(txn: DataFrame, cards: DataFrame, days: int = ACTIVE_DAYS, parts: int | None = None) -> DataFrame:
    """Steps of active cards and their transactions per segment that the card is in on that day."""
    daily = txn.select(_card(), "day", "is_error").groupBy("card_id", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"))
    steps = rolling.steps_from_deltas(rolling.sum_deltas(daily, ["card_id"], ["n", "failed"], days, parts=parts), ["card_id"], ["n", "failed"]).where("n > 0")
    both = steps.join(version_days(cards).select("card_id", "has_chip", "card_brand", "v_from", "v_to"), "card_id", "left")
    rows = both.select(*_segmented(), F.greatest("day", "v_from").alias("a"), F.least("until", "v_to").alias("b"), "n", "failed")
    names = ["active", "n", "failed"]
    return rolling.steps_from_deltas(_range_deltas(rows, SEGMENT, names), SEGMENT, names)


def _portfolio_day(txn: DataFrame, cards: DataFrame, batch: dt.date, days: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Issued and active cards per segment on one day, from the versions of its end and the rows of its window."""
    versions = version_days(cards).where((F.col("v_from") <= F.lit(batch)) & (F.col("v_to") > F.lit(batch)))
    again = F.col("num_cards_issued") - 1
    counts = [F.count_if(again == 0).alias("r0"), F.count_if(again == 1).alias("r1"), F.count_if(again >= 2).alias("r2"), F.sum(again).alias("reissues")]
    issued = versions.groupBy(clean.chip_segment(F.col("has_chip")).alias("chip_segment"), "card_brand").agg(F.count(F.lit(1)).alias("issued"), *counts)
    if state is not None:
        per_card = state.where("n > 0").select("card_id", "n", "failed")
    else:
        per_card = trailing_window(txn, batch, days).select(_card(), "is_error").groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"))
    both = per_card.join(versions.select("card_id", "has_chip", "card_brand", "v_from"), "card_id", "left").select(*_segmented(), "n", "failed")
    active = both.groupBy(*SEGMENT).agg(*(F.sum(c).alias(c) for c in ("active", "n", "failed")))
    return tuple(d.withColumn("day", F.lit(batch)) for d in (issued, active))


def card_portfolio(txn: DataFrame, cards: DataFrame, batch: dt.date | None = None, days: int = ACTIVE_DAYS, first: dt.date | None = None, state: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """A row per day and segment: issued, active and reissued cards, trailing transactions.

    batch: that day alone, from the rows of its window, or from the day's kept totals of PORTFOLIO (state); first: the first day of the history, where
    the caller knows it.
    """
    if batch is None:
        first, last = rolling.bounds(txn)
        issued, active = rolling.written_out(issued_steps(cards), first, last), rolling.written_out(active_steps(txn, cards, days, parts), first, last)
    else:
        first = first or rolling.bounds(txn)[0]
        issued, active = _portfolio_day(txn, cards, batch, days, state)
    out = issued.join(active, ["day", *SEGMENT], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        clean.date_key(F.col("day")).alias("date_key"), *SEGMENT, zero("issued").alias("issued_card_count"), zero("active").alias("active_card_count_90d"), zero("n").alias("transaction_count_90d"),
        (zero("n") - zero("failed")).alias("successful_transaction_count_90d"), zero("failed").alias("failed_transaction_count_90d"), zero("r0").alias("cards_reissued_0_count"),
        zero("r1").alias("cards_reissued_1_count"), zero("r2").alias("cards_reissued_2plus_count"), zero("reissues").alias("total_card_reissue_count"), rolling.window_days(F.col("day"), first, days).alias("window_day_count"),
    )


def rate(a: Column, b: Column) -> Column:
    """a / b to six digits, null where b is zero."""
    return F.round(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"), 6)


def primary_category(counts: Column) -> Column:
    """n, primary_mcc (most transactions, then the smallest) and distinct_mcc_count of an array of mcc and n, in which a category may come several times."""
    none = F.struct(F.lit(None).cast("string").alias("mcc"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("primary_mcc"), F.lit(0).cast("long").alias("most"), F.lit(0).cast("long").alias("distinct_mcc_count"))

    def add(so_far: Column, x: Column) -> Column:
        again = (so_far["n"] > 0) & so_far["mcc"].eqNullSafe(x["mcc"])
        n = F.when(again, so_far["n"] + x["n"]).otherwise(x["n"])
        more = n > so_far["most"]
        known = F.coalesce(x["mcc"] != "-1", F.lit(False))
        return F.struct(
            x["mcc"].alias("mcc"), n.alias("n"), F.when(more, x["mcc"]).otherwise(so_far["primary_mcc"]).alias("primary_mcc"), F.greatest(n, so_far["most"]).alias("most"),
            (so_far["distinct_mcc_count"] + (~again & known).cast("long")).alias("distinct_mcc_count"),
        )

    return F.aggregate(F.array_sort(counts), none, add)


def _merchant_days(txn: DataFrame, floor: int, days: int, parts: int | None) -> tuple[DataFrame, dt.date]:
    """merchant_id, day, n, failed, spend, portfolio_error_rate_30d, primary_mcc, distinct_mcc_count of all days, from daily sums that are written once; and the first day.

    A merchant's categories are looked at where its window changes, before days are written out. Transactions are dealt out by what they are summed by: few
    fall together, so sums before the shuffle would spare little, and the tasks' size is that of the parts.
    """
    daily = written(_merchant_sums(rolling.dealt(txn, ["merchant_id", "mcc", "day"], parts), "day"), "merchant-daily")
    first, last = rolling.bounds(daily)
    names = ["n", "failed", "spend"]
    coming = F.when(F.col("n") > 0, F.struct("mcc", "n"))  # not where a day leaves the window
    deltas = rolling.sum_deltas(daily, ["merchant_id"], names, days, ["mcc"], parts)
    changes = deltas.groupBy("merchant_id", "day").agg(*(F.sum(c).alias(c) for c in names), F.collect_list(coming).alias("counts"))
    w = Window.partitionBy("merchant_id").orderBy(F.unix_date("day"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = changes.select(
        "merchant_id", "day", F.lead("day").over(w).alias("until"), *(F.sum(c).over(past).alias(c) for c in names), F.flatten(F.collect_list("counts").over(w.rangeBetween(1 - days, 0))).alias("counts"),
    ).where(F.col("n") >= floor)
    steps = steps.withColumn("top", primary_category(F.col("counts"))).select("merchant_id", "day", "until", *names, "top.primary_mcc", "top.distinct_mcc_count")
    by_day = daily.groupBy("day").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).withColumn("all", F.lit(1))
    base = rolling.written_out(rolling.steps_from_deltas(rolling.sum_deltas(by_day, ["all"], ["n", "failed"], days), ["all"], ["n", "failed"]), first, last)
    base = base.select("day", rate(F.col("failed"), F.col("n")).alias("portfolio_error_rate_30d"))
    return rolling.written_out(steps, first, last).join(F.broadcast(base), "day"), first  # base has a row a day


def _merchant_sums(txn: DataFrame, *by: str) -> DataFrame:
    spend = F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).alias("spend")
    return txn.groupBy("merchant_id", "mcc", *by).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"), spend)


def merchant_windows(txn: DataFrame, floor: int, days: int = ERROR_DAYS, parts: int | None = None) -> tuple[DataFrame, dt.date]:
    """day, merchant_id and window_day_count of all rows of merchant_error(), and the first day of the history.

    Counts alone decide which rows the report has, so of the transactions merchant_id and day are all that is dealt out and written, once. They are dealt out by
    merchant and year: a merchant's days lie together, so what is written takes no more a row where there are more parts, and a large merchant is in several.
    """
    year = F.year("day")
    counts = rolling.dealt(txn.select("merchant_id", "day"), ["merchant_id", year], parts).groupBy("merchant_id", year, "day").agg(F.count(F.lit(1)).alias("n"))
    daily = written(counts.select("merchant_id", "day", "n").sortWithinPartitions("merchant_id", "day"), "merchant-counts")
    first, last = rolling.bounds(daily)
    steps = rolling.steps_from_deltas(rolling.sum_deltas(daily, ["merchant_id"], ["n"], days, parts=parts), ["merchant_id"], ["n"]).where(F.col("n") >= floor)
    return rolling.written_out(steps, first, last).select("day", "merchant_id", rolling.window_days(F.col("day"), first, days).alias("window_day_count")), first


def _merchant_day(txn: DataFrame, floor: int, batch: dt.date, days: int, state: DataFrame | None) -> DataFrame:
    """The same of one day, from the rows of its window or the kept sums."""
    pairs = state.where("n > 0").select("merchant_id", "mcc", "n", "failed", "spend") if state is not None else _merchant_sums(trailing_window(txn, batch, days))
    base = pairs.agg(rate(F.sum("failed"), F.sum("n")).alias("portfolio_error_rate_30d"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "mcc")).alias("top")
    rows = pairs.groupBy("merchant_id").agg(*(F.sum(c).alias(c) for c in ("n", "failed", "spend")), top, F.count_if(F.col("mcc") != "-1").alias("distinct_mcc_count")).where(F.col("n") >= floor)
    return rows.crossJoin(F.broadcast(base)).withColumns({"day": F.lit(batch), "primary_mcc": F.col("top.mcc")})  # base is one row


def merchant_error(txn: DataFrame, floor: int, threshold: float, batch: dt.date | None = None, days: int = ERROR_DAYS, first: dt.date | None = None, state: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Merchants with at least floor transactions in the trailing window, against the rate of all merchants on that day.

    Rates are kept to six digits, the failures to expect are rounded to two before they are subtracted, and the flag compares what is kept.
    batch: that day alone, from the rows of its window, or from the day's kept totals of MERCHANTS (state); first: the first day of the history, where
    the caller knows it.
    """
    if batch is None:
        rows, first = _merchant_days(txn, floor, days, parts)
    else:
        first = first or rolling.bounds(txn)[0]
        rows = _merchant_day(txn, floor, batch, days, state)
    own, base = rate(F.col("failed"), F.col("n")).cast("decimal(9,6)"), F.col("portfolio_error_rate_30d").cast("decimal(9,6)")
    expected = (F.col("n").cast("decimal(10,0)") * base).cast("decimal(12,2)")
    return rows.select(
        clean.date_key(F.col("day")).alias("date_key"), "merchant_id", "primary_mcc", "distinct_mcc_count", rolling.window_days(F.col("day"), first, days).alias("window_day_count"),
        F.col("n").alias("transaction_count_30d"), F.col("failed").alias("failed_transaction_count_30d"), own.alias("error_rate_30d"), base.alias("portfolio_error_rate_30d"),
        expected.alias("expected_failed_transactions_30d"), (F.col("failed").cast("decimal(10,0)") - expected).cast("decimal(12,2)").alias("excess_failed_transactions_30d"), F.col("spend").alias("total_spend_amount_30d"),
        F.lit(threshold).cast("decimal(5,4)").alias("applied_error_rate_threshold"), F.lit(floor).alias("applied_min_transaction_count"), (own > F.lit(threshold).cast("decimal(5,4)")).alias("is_abnormal_error_rate"),
    )


#: The kept states of the three reports, and the facts that move them.
ACTIVITY = TrailingState(("customer_id",), ("n",), ACTIVE_DAYS, "card_id", "cards")
PORTFOLIO = TrailingState(("card_id",), ("n", "failed"), ACTIVE_DAYS)
MERCHANTS = TrailingState(("merchant_id", "mcc"), ("n", "failed", "spend"), ERROR_DAYS)


def state_facts(txn: DataFrame, of: TrailingState) -> DataFrame:
    """Transactions as the facts of one of the three states."""
    one, failed = F.lit(1).cast("long").alias("n"), F.col("is_error").cast("long").alias("failed")
    if of is ACTIVITY:
        return txn.where(~F.col("customer_id").isin(*SENTINELS)).select("customer_id", F.when(~F.col("card_id").isin(*SENTINELS), F.col("card_id")).alias("card_id"), "day", one)
    if of is PORTFOLIO:
        return txn.select(_card(), "day", one, failed)
    return txn.select("merchant_id", "mcc", "day", one, failed, F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0).alias("spend"))


def by_excess(report: DataFrame, limit: int) -> DataFrame:
    """The merchants to look at first: those with the most failures beyond what is to be expected."""
    return report.orderBy(F.desc("excess_failed_transactions_30d"), "merchant_id").limit(limit)


#: Which dimensions each measure may be summed over (AG21): trailing, distinct and stock measures never over days.
ADDITIVE = {
    "transaction_count": {"date_key", "mcc", "merchant_id"}, "total_spend_amount": {"date_key", "mcc", "merchant_id"}, "total_inflow_amount": {"date_key", "mcc", "merchant_id"},
    "successful_transaction_count": {"date_key", "mcc", "merchant_id"}, "failed_transaction_count": {"date_key", "mcc", "merchant_id"}, "unique_cards": set(), "unique_customers": set(),
    "issued_card_count": {"chip_segment", "card_brand"}, "active_card_count_90d": {"chip_segment", "card_brand"}, "transaction_count_90d": {"chip_segment", "card_brand", "customer_id"},
    "failed_transaction_count_90d": {"chip_segment", "card_brand"}, "transaction_count_30d": {"merchant_id"}, "failed_transaction_count_30d": {"merchant_id"}, "error_rate_30d": set(),
}


def safe_rollup(df: DataFrame, by: Sequence[str], measures: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Sums of measures over the dimensions left out of by; ValueError where a measure is not additive over one of them."""
    gone = set(dims) - set(by)
    bad = sorted(m for m in measures if gone - ADDITIVE.get(m, set()))
    if bad:
        raise ValueError(f"not additive over {sorted(gone)}: {', '.join(bad)}")
    return df.groupBy(*by).agg(*(F.sum(m).alias(m) for m in measures))


def metric(df: DataFrame, numerator: Column, denominator: Column, by: Sequence[str], name: str) -> DataFrame:
    """A ratio of sums, never a mean of ratios."""
    return df.groupBy(*by).agg(rate(F.sum(numerator), F.sum(denominator)).alias(name))


def segment_metrics(rows: DataFrame, period: str, attributes: Sequence[str]) -> DataFrame:
    """Value, volume, active customers and mean amount per period and segment of each attribute, with the period before's value.

    Rows are summed per customer before they are counted once for each attribute. An attribute without a value is UNKNOWN.
    """
    each = rows.groupBy(period, "customer_id", *attributes).agg(F.sum(F.abs("amount")).alias("v"), F.count(F.lit(1)).alias("n"))
    kinds = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("UNKNOWN")).alias("segment")) for a in attributes)))
    out = each.select(period, "customer_id", "v", "n", kinds.alias("k")).groupBy(period, "k.attribute", "k.segment").agg(F.sum("v").alias("total_value"), F.sum("n").alias("transaction_count"), F.countDistinct("customer_id").alias("active_customers"))
    before = F.lag("total_value").over(Window.partitionBy("attribute", "segment").orderBy(period))
    return out.withColumns({"average_amount": F.round(F.col("total_value").cast("double") / F.col("transaction_count"), 4), "previous_value": before})


def before_after(fact: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spend on the versions before and after a change (see scd2.changes) by columns of the fact, and its share of all such spend."""
    side = lambda c, s: changes.select(F.col(c).alias("customer_key"), F.lit(s).alias("side"))
    spend = F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)
    rows = fact.join(side("before_key", "before").unionByName(side("after_key", "after")), "customer_key")
    sums = rows.groupBy(*by).agg(*(F.sum(F.when(F.col("side") == s, spend).otherwise(0)).alias(f"spend_{s}") for s in ("before", "after")))
    total = sums.agg(*(F.sum(f"spend_{s}").alias(f"total_{s}") for s in ("before", "after")))
    out = sums.crossJoin(F.broadcast(total))  # total is one row
    return out.withColumns({f"share_{s}": rate(F.col(f"spend_{s}"), F.col(f"total_{s}")) for s in ("before", "after")}).drop("total_before", "total_after")


def period_over_period(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Value, the previous period's, the change, and the share of the period's total."""
    w = Window.partitionBy(*by).orderBy(period)
    total = F.sum(value).over(Window.partitionBy(period))
    v = F.col(value).cast("double")
    return df.withColumns({"previous": F.lag(v).over(w), "share": F.round(v / total.cast("double"), 6)}).withColumn("change", F.round(v - F.col("previous"), 2))


def haversine_km() -> Column:
    """Great-circle distance of lat, lon and plat, plon."""
    hav = F.pow(F.sin(F.radians(F.col("plat") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("plat")) * F.pow(F.sin(F.radians(F.col("plon") - F.col("lon")) / 2), 2)
    return F.round(2 * 6371.0 * F.asin(F.sqrt(F.least(hav, F.lit(1.0)))), 6)


_CUBE = ["_x", "_y", "_z"]


def _on_sphere(lat: str, lon: str) -> list[Column]:
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def descended(points: DataFrame, places: DataFrame, side: float) -> DataFrame:
    """Each point (lat, lon) with the cubes of a side that may hold its nearest place (lat, lon, _x, _y, _z).

    The non-empty cubes are a tree: those of twice the side are their parents, up to the whole sphere. From its top, a point meets the children of
    the cubes that are left; one whose nearest side is farther than some place of another is dropped. A level has no more cubes than
    the sphere has room for, so its upper levels can be broadcast; beyond BROADCAST cubes it is a join on the cube.
    """
    top = max(0, math.ceil(math.log2(2 / side)))
    here = points.select("lat", "lon", *(c.alias(f"_p{k}") for k, c in enumerate(_on_sphere("lat", "lon"))))
    at = [c.alias(f"_q{k}") for k, c in enumerate(_on_sphere("plat", "plon"))]
    located = places.select(*at)
    rows = None
    for level in range(top, -1, -1):
        s = side * 2**level
        cells = located.groupBy(*(F.floor(F.col(f"_q{k}") / s).cast("long").alias(c) for k, c in enumerate(_CUBE))).agg(F.min(F.struct("_q0", "_q1", "_q2")).alias("_one"))
        if 16 * math.pi / s**2 + 64 <= BROADCAST:  # cubes of this side that the sphere can cut, generously
            cells = F.broadcast(cells)
        if rows is None:
            joined = here.crossJoin(cells)  # the top: eight cubes at most
        else:
            up = [F.floor(F.col(f"c.{c}") / 2).cast("long") == F.col(f"r.{c}") for c in _CUBE]
            joined = rows.alias("r").join(cells.alias("c"), up).select("lat", "lon", "_p0", "_p1", "_p2", *(F.col(f"c.{c}").alias(c) for c in _CUBE), "_one")
        outside = [F.greatest(F.col(c) * s - F.col(f"_p{k}"), F.col(f"_p{k}") - (F.col(c) + 1) * s, F.lit(0.0)) for k, c in enumerate(_CUBE)]
        nearest = F.sqrt(sum((o * o for o in outside[1:]), outside[0] * outside[0]))
        away = [F.col(f"_one._q{k}") - F.col(f"_p{k}") for k in range(3)]
        held = F.sqrt(sum((d * d for d in away[1:]), away[0] * away[0]))
        bound = F.min("_held").over(Window.partitionBy("lat", "lon"))
        # kilometres are rounded to six places: what may round to the same stays
        rows = joined.withColumns({"_near": nearest, "_held": held}).withColumn("_bound", bound).where(F.col("_near") <= F.col("_bound") + 1e-8).select("lat", "lon", "_p0", "_p1", "_p2", *_CUBE)
    return rows.select("lat", "lon", *_CUBE)


def _side(known: DataFrame, cell: float) -> float:
    """A cube's side: that of a cell, halved while the mean place shares its cube with more than CROWD others."""
    side = 2 * math.sin(math.radians(min(cell, 60.0)) / 2)
    at = known.select(*_on_sphere("plat", "plon"))
    while side > 1e-4:
        n = at.groupBy(*(F.floor(F.col(c) / side) for c in at.columns)).count()
        crowd = n.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
        if crowd is None or crowd <= CROWD:
            break
        side /= 2 if crowd <= 16 * CROWD else 4
    return side


#: Places that share a cube, in the mean over places.
CROWD = 8
#: Cubes of a level that are broadcast at most.
BROADCAST = 20_000


def nearest_place(points: DataFrame, places: DataFrame, cell: float = 2.0) -> DataFrame:
    """The nearest of all places (place, plat, plon) to each point (id, lat, lon), by great circle, the least place among equals; null without coordinates or places.

    Cells are cubes around points of the unit sphere, so neither the 180-degree line nor the poles are edges. A place outside the 27 cubes around a point is
    at least a cube's side away; points with no place nearer than that descend the tree of cubes (descended()). cell (degrees) is the largest side: it sets
    the work, not the result. Of places at one position the least stands for all, and the side shrinks with the number of positions, so a point does
    not meet more of them where there are more.
    """
    ring = F.array(*(F.array(F.lit(i), F.lit(j), F.lit(k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    cube = lambda lat, lon: [F.floor(c / side).cast("long") for c in _on_sphere(lat, lon)]
    known = places.where("plat IS NOT NULL AND plon IS NOT NULL").groupBy("plat", "plon").agg(F.min("place").alias("place")).select("place", "plat", "plon")
    side = _side(known, cell)
    here = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct().withColumns(dict(zip(_CUBE, cube("lat", "lon"), strict=True)))
    around = known.withColumn("_r", F.explode(ring)).select("place", "plat", "plon", *((c + F.col("_r")[k]).alias(_CUBE[k]) for k, c in enumerate(cube("plat", "plon"))))
    best = here.join(around, _CUBE, "left").withColumn("km", haversine_km()).groupBy("lat", "lon").agg(F.min(F.when(F.col("place").isNotNull(), F.struct("km", "place"))).alias("b"))
    best = written(best, "near-places")
    surely = F.coalesce(F.col("b.km") < 2 * 6371.0 * math.asin(side / 2) - 1e-5, F.lit(False))
    own = known.withColumns(dict(zip(_CUBE, cube("plat", "plon"), strict=True)))
    far = descended(best.where(~surely).select("lat", "lon"), known, side).join(own, _CUBE).withColumn("km", haversine_km()).groupBy("lat", "lon").agg(F.min(F.struct("km", "place")).alias("b"))
    every = best.where(surely).unionByName(far)
    return points.select("id", "lat", "lon").join(every, ["lat", "lon"], "left").select("id", F.col("b.place").alias("place"), F.col("b.km").alias("km"))
