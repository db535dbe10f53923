"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; a policy is a version and a mask over those bits, so policies are applied and compared without
reading the texts again, and ablations are bitwise aggregations of the ledger. DataFrame functions only.

Defined results: null and blank texts have no words (and fail the word rule); all arithmetic is on
whole numbers, so no ratio divides by zero; equal rows get equal ledger rows; an empty table gives an
empty ledger; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored, texts, words

SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
A_WORD = r"[^\x20\x09-\x0D]"

#: Bit by bit: name and failure condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "10 * word_chars < 15 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "100 * n_capitals > 60 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", (*BASE.rules, "symbols", "repeated_lines")), Policy("v2", tuple(BIT)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""
    text = F.col("text")
    step = texts(docs).select(
        "doc_id",
        words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD)).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(CAPITALS)).cast("long").alias("n_capitals"),
    )
    step = step.select(
        "doc_id", "n_symbols", "n_capitals",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))).alias("h"),
    )
    step = step.withColumn("s", F.sort_array("h"))
    step = step.withColumn("twice", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1)))))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.withColumn("p", F.when(F.size("twice") > 64, pairs))
    many = F.sort_array(F.transform(F.filter("p", lambda p, k: (p.x == F.get("p", k - 1).x) | (p.x == F.get("p", k + 1).x)), lambda p: p.i))
    step = step.withColumn("at", F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= 64, few).otherwise(many))
    # each position covers three words or as many as there are before the next position
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc.n + i + 3 - F.greatest(acc.end, i)).alias("n"), (i + 3).alias("end")),
        lambda acc: acc.n,
    )
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_capitals")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with failed_bits, one bit per failed rule."""
    bits = F.lit(0)
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(0))
    return measured(docs).withColumn("failed_bits", bits)


def recorded(docs: DataFrame) -> DataFrame:
    """The ledger, written: policies and ablations read its rows and never the texts."""
    return stored(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """kept: no rule of the policy failed. rows: a ledger."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0).withColumn("policy", F.lit(policy.version))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that fail the rule, and those that only this rule rejects."""
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    of = F.array(*(F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for p in policies for r in p.rules))
    hit = F.col("failed_bits").bitwiseAND(F.col("r.mask"))
    return (
        patterns.select("failed_bits", "n", F.explode(of).alias("r"))
        .groupBy("r.policy", "r.rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )
