"""Fraud rules: Structured Streaming jobs over transactions, and batch twins over event time.

Input columns: ts, customer_id, card_id, merchant_id, mcc, amount, is_error; ts is a timestamp in streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VELOCITY = {"VR001": ("card_id", 5, 5), "VR002": ("customer_id", 10, 10)}


def five_minute_counts(stream: DataFrame, late: str = "10 minutes", by: Sequence[str] = ("merchant_id",)) -> DataFrame:
    """Tumbling counts per merchant; distinct counts are approximate, as state must stay small."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", "5 minutes"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.approx_count_distinct("card_id").alias("cards"), F.approx_count_distinct("customer_id").alias("customers"), F.count_if("is_error").alias("failed"))
    )


def velocity_stream(stream: DataFrame, key: str, most: int, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Windows of so many minutes, sliding by one, with more than `most` transactions of a key."""
    w = F.window("ts", f"{minutes} minutes", "1 minute")
    return stream.withWatermark("ts", late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def spread_stream(stream: DataFrame, key: str, item: str, most: int, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Windows in which a key meets more than `most` different items (merchants, states)."""
    w = F.window("ts", f"{minutes} minutes", "1 minute")
    return stream.withWatermark("ts", late).groupBy(w, key).agg(F.size(F.collect_set(item)).alias("n")).where(F.col("n") > most)


def unusual_pattern_stream(stream: DataFrame, profile: DataFrame, factor: float = 3.0) -> DataFrame:
    """BR003: running hourly counts of a customer far above what the profile (customer_id, hour, usual) has for that hour of the day."""
    counts = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "customer_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("hour", F.hour("window.start"))
    return counts.join(profile, ["customer_id", "hour"]).where(F.col("n") > factor * F.col("usual"))


def spending_stream(stream: DataFrame, profile: DataFrame, factor: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """BR001: days on which a customer spends more than factor times the daily mean of its profile (customer_id, daily_mean)."""
    spent = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "customer_id").agg(F.sum(F.abs(F.col("amount").cast("double"))).alias("spent"))
    return spent.join(profile.select("customer_id", "daily_mean"), "customer_id").where(F.col("spent") > factor * F.col("daily_mean"))


def merchant_stream(stream: DataFrame, profile: DataFrame, volume: float = 3.0, failures: float = 2.0, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """MR001, MR002: windows in which a merchant's volume or failure rate exceeds so many times its profile's (merchant_profile())."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "merchant_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"))
    rows = counts.join(profile, "merchant_id").withColumns({"MR001": F.col("n") > volume * F.col("usual"), "MR002": F.col("failed") > failures * F.col("failure_rate") * F.col("n")})
    return rows.where("MR001 OR MR002")


def new_card_stream(stream: DataFrame, known: DataFrame, share: float = 0.5, least: int = 2, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """MR003: windows of a merchant in which more than a share of the cards are not among those it has met (known: merchant_id, card_id)."""
    met = known.select("merchant_id", "card_id").distinct().withColumn("_met", F.lit(True))
    rows = stream.withWatermark("ts", late).join(met, ["merchant_id", "card_id"], "left")
    sets = F.collect_set("card_id"), F.collect_set(F.when(F.col("_met").isNull(), F.col("card_id")))
    counts = rows.groupBy(F.window("ts", f"{minutes} minutes"), "merchant_id").agg(*(F.size(s).alias(n) for s, n in zip(sets, ("cards", "new_cards"), strict=True)))
    return counts.where((F.col("cards") >= least) & (F.col("new_cards") > share * F.col("cards")))


def against_profile(stream: DataFrame, profile: DataFrame, key: str, hit: Column) -> DataFrame:
    """Transactions that exceed a static daily profile (a stream-static join)."""
    return stream.join(profile, key).where(hit)


def merchant_profile(txn: DataFrame, minutes: int = 5) -> DataFrame:
    """merchant_id, its mean count of a bucket with transactions (usual), and its failure rate."""
    counts = _buckets(txn, minutes).groupBy("merchant_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"))
    return counts.groupBy("merchant_id").agg(F.avg("n").alias("usual"), (F.sum("failed") / F.sum("n")).alias("failure_rate"))


#: The rule under which all transactions are counted.
EVERY = "ALL"


def operations_snapshot(txn: DataFrame, hits: dict[str, DataFrame], high: float, minutes: int = 5) -> DataFrame:
    """Counts by window, rule, merchant and state, of frames or of streams with one watermark column ts.

    hits: the transactions that each rule names, with the columns of txn. Rows of EVERY count all transactions and no violation, those of a rule the transactions that
    violate it; high: the amount above which a transaction is of high value.
    """
    columns = ["ts", "merchant_id", "state", "card_id", "customer_id", "amount", "is_error"]
    parts = [df.select(F.lit(rule).alias("rule"), *columns) for rule, df in {EVERY: txn, **hits}.items()]
    rows = reduce(DataFrame.unionByName, parts)
    size = F.abs(F.col("amount").cast("double"))
    counts = rows.groupBy(F.window("ts", f"{minutes} minutes"), "rule", "merchant_id", "state").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("transaction_amount"), F.size(F.collect_set("card_id")).alias("unique_cards"),
        F.size(F.collect_set("customer_id")).alias("unique_customers"), F.count_if(F.col("rule") != EVERY).alias("rule_violation_count"), F.count_if("is_error").alias("failed_transaction_count"),
        F.count_if(size > high).alias("high_value_transaction_count"),
    )
    return counts.select(F.col("window.start").alias("window_start"), *(c for c in counts.columns if c != "window"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def trailing(key: str, minutes: int):
    """Event-time frame that ends with the current row."""
    return Window.partitionBy(key).orderBy(_micros(F.col("ts"))).rangeBetween(-minutes * 60_000_000, 0)


def velocity(txn: DataFrame, key: str, most: int, minutes: int) -> DataFrame:
    """Transactions at which a key has more than `most` within the last minutes."""
    return txn.withColumn("n", F.count(F.lit(1)).over(trailing(key, minutes))).where(F.col("n") > most)


def spread(txn: DataFrame, key: str, item: str, most: int, minutes: int) -> DataFrame:
    return txn.withColumn("n", F.size(F.collect_set(item).over(trailing(key, minutes)))).where(F.col("n") > most)


def daily_profile(txn: DataFrame, key: str) -> DataFrame:
    """Mean and 95th percentile of a key's amounts, its daily mean and count, its failure rate and the categories it has met."""
    size = F.abs(F.col("amount").cast("double"))
    days = F.countDistinct("day")
    return txn.groupBy(key).agg(
        F.avg(size).alias("mean_amount"), F.percentile(size, 0.95).alias("p95_amount"), (F.sum(size) / days).alias("daily_mean"), (F.count(F.lit(1)) / days).alias("daily_count"),
        (F.count_if("is_error") / F.count(F.lit(1))).alias("failure_rate"), F.collect_set("mcc").alias("categories"),
    )


#: What each rule asks of a transaction joined with a profile of its key (AR001: over the last 30 days; AR003, GR002 and GR003: with limit,
#: home and states met of the customer).
RULES = {
    "AR001": lambda: F.abs(F.col("amount").cast("double")) > 3 * F.col("mean_amount"),
    "AR002": lambda: F.abs(F.col("amount").cast("double")) > F.col("p95_amount"),
    "AR003": lambda: F.abs(F.col("amount").cast("double")) > 0.8 * F.col("credit_limit"),
    "GR002": lambda: F.col("state") != F.col("home"),
    "GR003": lambda: ~F.array_contains("states", F.col("state")),
    "BR002": lambda: ~F.array_contains("categories", F.col("mcc")),
}


def against(txn: DataFrame, profile: DataFrame, key: str, rule: str) -> DataFrame:
    """Transactions, streamed or not, that a rule of RULES finds against a static profile."""
    return against_profile(txn, profile, key, RULES[rule]())


def states_within(txn: DataFrame, minutes: int = 30, item: str = "state") -> DataFrame:
    """GR001: transactions at which a card has been in more than one state within the last minutes."""
    return spread(txn, "card_id", item, 1, minutes)


def _buckets(txn: DataFrame, minutes: int) -> DataFrame:
    return txn.withColumn("bucket", F.floor(_micros(F.col("ts")) / F.lit(minutes * 60_000_000)))


def failing_merchants(txn: DataFrame, factor: float = 2.0, minutes: int = 5, least: int = 1) -> DataFrame:
    """MR002: buckets of a merchant whose failure rate exceeds factor times its rate over all that came before them."""
    counts = _buckets(txn, minutes).groupBy("merchant_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"))
    w = Window.partitionBy("merchant_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    past = counts.withColumns({"past_n": F.sum("n").over(w), "past_failed": F.sum("failed").over(w)})
    return past.where((F.col("n") >= least) & (F.col("past_n") > 0) & (F.col("failed") * F.col("past_n") > factor * F.col("past_failed") * F.col("n")))


def new_card_merchants(txn: DataFrame, share: float = 0.5, minutes: int = 5, least: int = 2) -> DataFrame:
    """MR003: buckets of a merchant in which more than a share of the cards are there for the first time."""
    rows = _buckets(txn, minutes).groupBy("merchant_id", "bucket", "card_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("merchant_id", "card_id").agg(F.min("bucket").alias("first"))
    counts = rows.join(first, ["merchant_id", "card_id"]).groupBy("merchant_id", "bucket").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("bucket") == F.col("first")).alias("new_cards"))
    return counts.where((F.col("cards") >= least) & (F.col("new_cards") > share * F.col("cards")))


def spending_surge(txn: DataFrame, factor: float = 3.0) -> DataFrame:
    """BR001: days on which a customer spends more than factor times the mean of its spending days before."""
    daily = txn.groupBy("customer_id", "day").agg(F.sum(F.abs("amount").cast("double")).alias("spent"))
    w = Window.partitionBy("customer_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn("usual", F.round(F.avg("spent").over(w), 4)).where(F.col("spent") > factor * F.col("usual"))


def hour_profile(txn: DataFrame) -> DataFrame:
    """Mean count of a customer per day in each hour of the day."""
    hours = txn.groupBy("customer_id", "day", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = txn.groupBy("customer_id").agg(F.countDistinct("day").alias("days"))
    return hours.groupBy("customer_id", "hour").agg(F.sum("n").alias("n")).join(days, "customer_id").select("customer_id", "hour", (F.col("n") / F.col("days")).alias("usual"))


def unusual_pattern(txn: DataFrame, factor: float = 3.0) -> DataFrame:
    """BR003: hours in which a customer has more than factor times its usual number of transactions for that hour."""
    hours = txn.groupBy("customer_id", "day", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(hour_profile(txn), ["customer_id", "hour"]).where(F.col("n") > factor * F.col("usual"))


def unusual_amount(txn: DataFrame, days: int = 30, factor: float = 3.0) -> DataFrame:
    """Transactions above factor times the customer's mean of the days before (the day itself left out)."""
    w = Window.partitionBy("customer_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    size = F.abs(F.col("amount").cast("double"))
    return txn.withColumns({"size": size, "usual": F.round(F.avg(size).over(w), 4)}).where(F.col("size") > factor * F.col("usual"))


def unseen(txn: DataFrame, key: str, item: str) -> DataFrame:
    """First transactions of a key with an item, apart from its first day."""
    first_item = txn.groupBy(key, item).agg(F.min("ts").alias("ts"))
    first = txn.groupBy(key).agg(F.min("day").alias("_first"))
    return first_item.join(first, key).where(F.to_date("ts") > F.col("_first")).drop("_first")


def merchant_surge(txn: DataFrame, factor: float = 3.0, minutes: int = 5) -> DataFrame:
    """Buckets in which a merchant's volume exceeds factor times its mean bucket."""
    bucket = F.floor(_micros(F.col("ts")) / F.lit(minutes * 60_000_000)).alias("bucket")
    counts = txn.groupBy("merchant_id", bucket).agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("merchant_id").agg(F.avg("n").alias("usual"))
    return counts.join(usual, "merchant_id").where(F.col("n") > factor * F.col("usual")).withColumn("usual", F.round("usual", 6))
