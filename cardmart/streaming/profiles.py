"""Profiles that move with the stream: what each key usually does, kept between micro-batches.

A micro-batch is held against the profile of all that came before it, and then added to it, so a change in one batch shows in the next.
The profile's parts are mergeable (counts, sums, sets, quantile sketches), lie in Buckets, and each batch counts once. The hits of a
batch are written beside them before its commit; a batch that runs again writes the same hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import path_exists
from .feed import Buckets, run_once
from .rules import RULES, against

#: Size of the quantile sketches (their error is below 1.7 % of the rank), and the sets that are kept of a key.
SKETCH, SETS = 200, {"days": "date", "categories": "string", "states": "string"}


def parts(txn: DataFrame, key: str) -> DataFrame:
    """The mergeable parts of each key's profile. txn: the key, ts, amount, is_error, mcc, state."""
    size = F.abs(F.col("amount").cast("double"))
    return txn.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("failed"), F.sum(size).alias("total"), F.kll_sketch_agg_double(size, F.lit(SKETCH)).alias("sizes"),
        F.collect_set(F.to_date("ts")).alias("days"), F.collect_set("mcc").alias("categories"), F.collect_set("state").alias("states"),
    )


def merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts of before and of now as one (two rows a key at most)."""
    sums = [F.sum(c).alias(c) for c in ("n", "failed", "total")]
    sets = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in SETS]
    return rows.groupBy(*by).agg(*sums, F.kll_merge_agg_double("sizes", F.lit(SKETCH)).alias("sizes"), *sets)


def usual(rows: DataFrame) -> DataFrame:
    """Parts as what the rules ask for: mean and 95th percentile of the amounts, daily mean and count, failure rate, what has been met."""
    days = F.greatest(F.size("days"), F.lit(1))
    return rows.withColumns({
        "mean_amount": F.col("total") / F.col("n"), "p95_amount": F.kll_sketch_get_quantile_double("sizes", F.lit(0.95)), "daily_mean": F.col("total") / days, "daily_count": F.col("n") / days,
        "failure_rate": F.col("failed") / F.col("n"),
    }).drop("sizes", "days", "n", "failed", "total")


@dataclass
class KeptProfile(Buckets):
    """The profile of one key column under a path."""

    def _parts(self, spark: SparkSession, txn: DataFrame) -> DataFrame:
        return self.rows(spark, parts(txn, self.keys[0]).schema)

    def profile(self, txn: DataFrame) -> DataFrame:
        """The profile as it is now; txn: a frame whose key has the right type."""
        return usual(self._parts(txn.sparkSession, txn))

    def apply(self, batch: DataFrame, batch_id: int, rules: Sequence[str], source: str = "stream") -> bool:
        """Find a batch's hits against the profile of before, then add the batch to it; False if that has been done before."""
        known = self.profile(batch)

        def aside(commit: int) -> None:
            for rule in rules:
                if rule not in RULES:
                    raise ValueError(f"unknown rule: {rule}")
                hits = against(batch, known, self.keys[0], rule).select(F.lit(rule).alias("rule"), *batch.columns)
                hits.write.mode("overwrite").parquet(f"{self.path}/hits/commit={commit}/of={rule}")

        by = [*self.keys, "bucket"]
        return self.take(batch, batch_id, source, lambda df: parts(df, self.keys[0]), lambda df: merged(df, by), aside)

    def hits(self, spark: SparkSession) -> DataFrame | None:
        """All hits of batches that are committed, with their commit."""
        last = self._manifest(spark)[0]
        if last < 0 or not path_exists(spark, f"{self.path}/hits"):
            return None
        return spark.read.parquet(f"{self.path}/hits").where(F.col("commit") <= last).drop("of")

    def start(self, stream: DataFrame, checkpoint: str, rules: Sequence[str], source: str = "stream") -> StreamingQuery:
        return run_once(stream, checkpoint, lambda df, i: self.apply(df, i, rules, source))
