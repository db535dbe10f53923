"""Order and event tables as card transactions, customers, cards and merchants."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import rolling
from ..operators.dedup import latest_per_key

#: Error codes, and the dates from which the two customer states hold.
ERROR_CODES = ("BAD PIN", "BAD CVV", "INSUFFICIENT BALANCE", "TECHNICAL GLITCH", "BAD CARD NUMBER", "BAD EXPIRATION", "BAD ZIPCODE")
STATE_A, STATE_B = dt.date(1995, 1, 1), dt.date(1998, 1, 1)
BRANDS = ("VISA", "MASTERCARD", "AMEX", "DISCOVER")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a line in the order in which they decide which of its copies is the latest.
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


#: Rows that a task gets where they are dealt out by key: with the input tasks become more, not larger.
TASK_ROWS = 300_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Number of parts to deal the order lines out to; their count comes from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(table(spark, sf_dir, "lineitem").count() / TASK_ROWS))


def unique_lines(spark: SparkSession, sf_dir: str, since: dt.date | None = None, until: dt.date | None = None, columns: Sequence[str] = LINE_ORDER) -> DataFrame:
    """Order lines, the latest of each key, with some of their columns; since, until: of these only the ones of a range of days.

    The lower bound is applied where the lines are read: an older line is not the latest of its key, or is out of the
    range itself. A later line may be the latest, so the upper bound has to wait. Columns that come after the last wanted one decide nothing
    about it and are not read. Lines are dealt out by order, so the join with the orders moves them no more.
    """
    lines = table(spark, sf_dir, "lineitem")
    if since is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz"))
    deciding = LINE_ORDER[: 1 + max((LINE_ORDER.index(c) for c in columns), default=0)]
    lines = lines.select("l_orderkey", "l_linenumber", *deciding)
    lines = rolling.dealt(lines, ["l_orderkey"], parts(spark, sf_dir) if since is None else None)
    lines = latest_per_key(lines, ["l_orderkey", "l_linenumber"], deciding)
    return lines if until is None else lines.where(F.col("l_shipdate") < F.lit(f"{until + dt.timedelta(days=1)} 00:00:00").cast("timestamp_ntz"))


def first_day(spark: SparkSession, sf_dir: str) -> dt.date:
    """The first day of the history."""
    lines = latest_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return lines.agg(F.min(F.to_date("l_shipdate"))).first()[0]


def last_seen(spark: SparkSession, sf_dir: str, until: dt.date) -> DataFrame:
    """customer_id and the day of its last transaction up to a day: four columns of the whole history."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = latest_per_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    lines = lines.select("l_orderkey", F.to_date("l_shipdate").alias("day")).where(F.col("day") <= F.lit(until))
    per_order = lines.groupBy("l_orderkey").agg(F.max("day").alias("day"))
    return per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("string").alias("customer_id")).agg(F.max("day").alias("last_day"))


#: Columns of transactions(), with the columns of the line that they come from.
TRANSACTION = {
    "transaction_id": [], "ts": ["l_shipdate"], "day": ["l_shipdate"], "date_key": ["l_shipdate"], "customer_id": [], "card_id": [], "merchant_id": ["l_suppkey"], "mcc": ["l_partkey"],
    "merchant_nation": ["l_suppkey"], "amount": ["l_extendedprice", "l_returnflag"], "is_error": ["l_partkey"], "errors": ["l_partkey"],
}


def transactions(spark: SparkSession, sf_dir: str, since: dt.date | None = None, until: dt.date | None = None, columns: Sequence[str] = tuple(TRANSACTION)) -> DataFrame:
    """One row per order line: returned lines are inflow, the others spend. columns: the ones that are wanted; all rows, but only what these need is read and moved.

    Parts and suppliers have one row per key.
    """
    rows = unique_lines(spark, sf_dir, since, until, sorted({c for x in columns for c in TRANSACTION[x]}))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "mcc" in columns:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    if "merchant_nation" in columns:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        rows = rows.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    amount = F.col("l_extendedprice").cast(clean.MONEY)
    code = F.element_at(F.array(*map(F.lit, ERROR_CODES)), (F.pmod("l_orderkey", F.lit(7)) + 1).cast("int"))
    is_error = F.pmod("l_partkey", F.lit(50)) == 0
    made = {
        "transaction_id": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "ts": F.col("l_shipdate"),
        "day": F.to_date("l_shipdate"),
        "date_key": clean.date_key(F.col("l_shipdate")),
        "customer_id": F.col("o_custkey").cast("string"),
        "card_id": F.concat_ws("-", "o_custkey", F.pmod("l_orderkey", F.lit(3))),
        "merchant_id": F.col("l_suppkey").cast("string"),
        "mcc": F.coalesce("p_type", F.lit("-1")),
        "merchant_nation": F.col("s_nationkey"),
        "amount": F.when(F.col("l_returnflag") == "R", amount).otherwise(-amount),
        "is_error": is_error,
        "errors": F.when(is_error, F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.array(code)).otherwise(F.array(code, F.lit("OTHER")))),
    }
    return rows.select(*(made[c].alias(c) for c in columns))


def day_bounds(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    """The first and the last day with transactions."""
    return rolling.bounds(transactions(spark, sf_dir, columns=["day"]))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cities of their regions: n_nationkey, city, state, zip."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.lit(" ").alias("zip"))


def placed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transactions() with the merchant's place and a type."""
    place = places(spark, sf_dir).select(F.col("n_nationkey").alias("merchant_nation"), F.col("city").alias("merchant_city"), F.col("state").alias("merchant_state"), "zip")
    rows = transactions(spark, sf_dir).join(place, "merchant_nation", "left")
    return rows.withColumn("transaction_type", F.when(F.col("amount") > 0, "REFUND").otherwise("PURCHASE"))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, home (nation) and credit_limit."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_nationkey").alias("home"), (F.round("c_acctbal", 2) + 2000).alias("credit_limit"))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, to the microsecond."""
    e = table(spark, sf_dir, "events")
    value = F.col("value").cast(clean.MONEY)
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        "ts",
        F.to_date("ts").alias("day"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.concat_ws("-", "user_id", F.pmod("event_id", F.lit(3))).alias("card_id"),
        F.get_json_object("props", "$.k").alias("merchant_id"),
        F.col("event_type").alias("mcc"),
        F.when(F.col("event_type").isin("purchase", "view"), -value).when(F.col("event_type") == "signup", value).otherwise(F.lit(0).cast(clean.MONEY)).alias("amount"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def customer_state(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """customer_id with its attributes, first state or later one."""
    c = table(spark, sf_dir, "customer")
    income = F.col("c_acctbal")
    if later:
        income = F.when(F.pmod("c_custkey", F.lit(3)) == 0, income + 5000).otherwise(income)
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.round(income, 2).alias("yearly_income"), clean.bracket(income, 2000, 7000).alias("income_bracket"), (F.lit(1940) + F.pmod("c_custkey", F.lit(60))).cast("int").alias("birth_year"),
    )


def card_state(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Three cards per customer; later, the cards of every fifth customer are reissued with a chip."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    again = (F.pmod("c_custkey", F.lit(5)) == 0) if later else F.lit(False)
    return c.select(
        F.concat_ws("-", "c_custkey", "n").alias("card_id"), F.col("c_custkey").cast("string").alias("customer_id"),
        F.element_at(F.array(*map(F.lit, BRANDS)), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int")).alias("card_brand"),
        ((F.pmod("c_custkey", F.lit(2)) == 0) | again).alias("has_chip"), F.when(again, 2).otherwise(1).cast("int").alias("num_cards_issued"),
    )
