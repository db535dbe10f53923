"""Slowly changing history: snapshots, dimensions, interval audits and point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import md5_key
from .dedup import latest_per_key

OPEN_END = "9999-12-31 23:59:59"
FIRST = "1900-01-01 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def changed(left: str, right: str, columns: Sequence[str]) -> Column:
    """Whether any column differs, null-safe."""
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def snapshot(prev: DataFrame | None, current: DataFrame, key: str, tracked: Sequence[str], at: Column, gap: Column | None = None) -> DataFrame:
    """History after a batch: valid_from, valid_to (null: open). A tracked change closes the open version and opens another.

    Columns that are not tracked follow the batch without a new version; keys that the batch lacks stay open. A batch that is not newer than
    a version leaves it whole (see published() for late batches). gap: what the closing time lies before the next opening (none: half-open intervals).
    """
    fresh = current.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp_ntz")})
    if prev is None:
        return fresh
    # one join, told apart row by row: no union of branches, whose partitions need not agree. Both sides have every key and are wider than their files, so neither may be broadcast
    same = (F.col(f"o.{key}") == F.col(f"n.{key}")) & F.col("o.valid_to").isNull()
    both = prev.withColumn("_there", F.lit(True)).alias("o").join(current.alias("n").hint("merge"), same, "full")
    is_new, absent = F.col("o._there").isNull(), F.col(f"n.{key}").isNull()  # a closed version meets no row of the batch
    stays = absent | (F.col("o.valid_from") > at)
    differs = F.when(is_new | absent, False).otherwise(changed("o", "n", tracked)) & (F.col("o.valid_from") < at)
    end = at - gap if gap is not None else at
    names = [c for c in current.columns if c != key]
    old = F.struct(
        F.col(f"o.{key}").alias(key),
        *(F.when(differs | stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in names),
        F.col("o.valid_from").alias("valid_from"),
        F.when(differs, end).otherwise(F.col("o.valid_to")).alias("valid_to"),
    )
    opened = F.struct(F.col(f"n.{key}").alias(key), *(F.col(f"n.{c}").alias(c) for c in names), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    made = F.array_compact(F.array(F.when(~is_new, old), F.when(is_new | differs, opened)))
    return both.select(F.explode(made).alias("_v")).select(*(F.col(f"_v.{c}").alias(c) for c in fresh.columns))


#: Columns of a history besides the key and its attributes; seen: every observation of the version, as its time and the untracked attributes.
VERSION = ("valid_from", "valid_to", "version_number", "seen")


def _attributes(columns: Sequence[str], key: str, tracked: Sequence[str], at: str = "at") -> tuple[list[str], list[str]]:
    names = [c for c in columns if c not in (key, at, *VERSION)]
    return names, [c for c in names if c not in tracked]


def history(observations: DataFrame, key: str, tracked: Sequence[str], at: str = "at", order: Sequence[str] = ()) -> DataFrame:
    """The versions of each key, from observations (key, attributes, time) in any order: one window pass over their change points.

    Of several observations of a key at one time the greatest order columns count. A version begins where a tracked attribute differs from the observation
    before (null-safe), ends where the next begins (open: null) and has the untracked attributes of its last observation.
    """
    names, loose = _attributes(observations.columns, key, tracked, at)
    names, loose = ([c for c in cs if c not in order] for cs in (names, loose))
    rows = latest_per_key(observations, [key, at], list(order)).drop(*order)
    w = Window.partitionBy(key).orderBy(at)
    state = F.struct(*tracked)
    begins = F.lag(at).over(w).isNull() | ~state.eqNullSafe(F.lag(state).over(w))
    numbered = rows.withColumn("version_number", F.sum(begins.cast("int")).over(w).cast("int"))
    versions = numbered.groupBy(key, "version_number").agg(
        F.min(at).alias("valid_from"),
        F.max_by(F.struct(*names), at).alias("_last"),
        F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), *loose))).alias("seen"),
    )
    until = F.lead("valid_from").over(Window.partitionBy(key).orderBy("version_number"))
    return versions.select(key, *(F.col(f"_last.{c}").alias(c) for c in names), "valid_from", until.alias("valid_to"), "version_number", "seen")


def published(before: DataFrame | None, batch: DataFrame, key: str, tracked: Sequence[str], at: Column, late: str = "split", order: Sequence[str] = ()) -> DataFrame:
    """A history after one more batch, which may be late, repeated or delivered again.

    Of a key's several rows in the batch the greatest order columns count (the other columns break ties). Keys whose last observation is older than the batch
    go on from their open version alone; a new version opens where a tracked attribute differs. late, for the other keys: "split" puts the
    observation where it belongs, so that any order of batches gives the history of the sorted one and a batch that comes again replaces its own
    observations; "ignore" drops what does not begin after the open version. Keys that the batch lacks stay as they are.
    """
    if late not in ("split", "ignore"):
        raise ValueError(f"unknown way to treat late rows: {late}")
    rows = latest_per_key(batch, [key], list(order)).withColumn("at", at)
    if before is None:
        return history(rows, key, tracked)
    names, loose = _attributes(before.columns, key, tracked)
    if "seen" not in before.columns:  # a history of before there were late batches
        before = before.withColumn("seen", F.array(F.struct(F.col("valid_from").alias("at"), *loose)))
    columns = [*names, *VERSION]
    # a key's versions beside its row of the batch; the open version goes with one of the rows, a new key with its only one
    both = before.select(key, F.struct(*columns).alias("_old")).join(rows.select(key, F.struct("at", *names).alias("_new")), key, "full")
    is_open = F.col("_old").isNotNull() & F.col("_old.valid_to").isNull()
    both = both.withColumns({"_open": F.first(F.when(is_open, F.col("_old")), ignorenulls=True).over(Window.partitionBy(key)), "_here": is_open | F.col("_old").isNull()})
    state = lambda x: F.struct(*(F.col(f"{x}.{c}").alias(c) for c in tracked))
    newest = F.array_max(F.transform("_open.seen", lambda s: s["at"])) if late == "split" else F.col("_open.valid_from")
    kind = F.when(F.col("_new").isNull(), "absent").when(F.col("_open").isNull(), "new").when(F.col("_new.at") <= newest, "late").when(state("_new").eqNullSafe(state("_open")), "same").otherwise("changed")
    both = both.withColumn("_kind", kind)
    seen = lambda x, at: F.struct(F.col(f"{x}.{at}").alias("at"), *(F.col(f"{x}.{c}").alias(c) for c in loose))
    going_on, closed = (F.col("_here") & (F.col("_kind") == k) for k in ("same", "changed"))
    kept = F.struct(
        *(F.when(going_on, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) if c in loose else F.col(f"_old.{c}").alias(c) for c in names),
        F.col("_old.valid_from").alias("valid_from"),
        F.when(closed, F.col("_new.at")).otherwise(F.col("_old.valid_to")).alias("valid_to"),
        F.col("_old.version_number").alias("version_number"),
        F.when(going_on, F.concat("_old.seen", F.array(seen("_new", "at")))).otherwise(F.col("_old.seen")).alias("seen"),
    )
    opened = F.struct(
        *(F.col(f"_new.{c}").alias(c) for c in names), F.col("_new.at").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        (F.coalesce("_open.version_number", F.lit(0)) + 1).alias("version_number"), F.array(seen("_new", "at")).alias("seen"),
    )
    opens = F.col("_here") & F.col("_kind").isin("new", "changed")
    made = F.array_compact(F.array(F.when(F.col("_old").isNotNull(), kept), F.when(opens, opened)))
    told = both if late == "ignore" else both.where(F.col("_kind") != "late")
    out = told.select(key, F.explode(made).alias("_v")).select(key, *(F.col(f"_v.{c}").alias(c) for c in columns))
    if late == "ignore":
        return out
    fixed = [c for c in names if c not in loose]
    before_now = F.transform("_old.seen", lambda s: F.struct(*(F.col(f"_old.{c}").alias(c) for c in fixed), *(s[c].alias(c) for c in loose), s["at"].alias("at"), F.lit(0).alias("_delivery")))
    now = F.array(F.struct(*(F.col(f"_new.{c}").alias(c) for c in (*fixed, *loose, "at")), F.lit(1).alias("_delivery")))
    observed = both.where(F.col("_kind") == "late").select(key, F.explode(F.concat(before_now, F.when(F.col("_here"), now).otherwise(F.slice(now, 1, 0)))).alias("_o"))
    again = history(observed.select(key, "_o.*"), key, tracked, order=["_delivery"])
    return out.unionByName(again.select(*out.columns))


def settled(versions: DataFrame, before: Column) -> DataFrame:
    """A history without the observations older than a time before which no batch comes any more (each version keeps its first and its last)."""
    n = F.size("seen")
    return versions.withColumn("seen", F.filter("seen", lambda s, k: (k == 0) | (k == n - 1) | (s["at"] >= before)))


def dimension(history: DataFrame, key: str, surrogate: str, unknown: dict | None = None) -> DataFrame:
    """Versions numbered from 1 on, the first valid from 1900 on, open ends in 9999, and a surrogate key of the key and the original start."""
    w = Window.partitionBy(key).orderBy("valid_from")
    rows = history.withColumn("version_number", F.row_number().over(w)).select(
        md5_key(F.col(key), F.col("valid_from")).alias(surrogate),
        *(c for c in history.columns if c not in ("valid_from", "valid_to")),
        F.when(F.col("version_number") == 1, ntz(FIRST)).otherwise(F.col("valid_from")).alias("effective_from"),
        F.coalesce("valid_to", ntz(OPEN_END)).alias("effective_to"),
        F.col("valid_to").isNull().alias("is_current"),
        "version_number",
    )
    return with_unknown(rows, surrogate, key, unknown or {})


def single_version(current: DataFrame, key: str, surrogate: str, at: Column) -> DataFrame:
    """A dimension of one version a key, open from a batch on, with a surrogate key of the key and that start."""
    return current.select(
        md5_key(F.col(key), at).alias(surrogate), *current.columns, at.alias("effective_from"), ntz(OPEN_END).alias("effective_to"), F.lit(True).alias("is_current"), F.lit(1).cast("short").alias("version_number")
    )


def changes(dim: DataFrame, key: str, surrogate: str, column: str) -> DataFrame:
    """Versions in which a column differs from the version before: key, before_key, after_key, before, after."""
    w = Window.partitionBy(key).orderBy("version_number")
    rows = dim.select(key, F.lag(surrogate).over(w).alias("before_key"), F.col(surrogate).alias("after_key"), F.lag(column).over(w).alias("before"), F.col(column).alias("after"))
    return rows.where(F.col("before_key").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))


def with_unknown(dim: DataFrame, surrogate: str, key: str, values: dict, members: Sequence[str] = ("-1", "-2")) -> DataFrame:
    """The dimension and its Unknown and Not-Applicable members, typed like it."""
    spark = dim.sparkSession
    fixed = {"effective_from": ntz(FIRST), "effective_to": ntz(OPEN_END), "is_current": F.lit(True), "version_number": F.lit(1)}
    extra = spark.createDataFrame([(m,) for m in members], ["_m"]).select(
        *(
            (F.col("_m") if c in (surrogate, key) else fixed[c] if c in fixed else F.lit(values.get(c))).cast(dim.schema[c].dataType).alias(c)
            for c in dim.columns
        )
    )
    return dim.unionByName(extra)


def changed_since(history: DataFrame, newest) -> DataFrame:
    """Versions that began or ended after the newest valid_from that a target has (None: all), as literal predicates."""
    if newest is None:
        return history
    after = F.lit(newest)
    return history.where((F.col("valid_from") > after) | (F.coalesce("valid_to", ntz(OPEN_END)) > after))


def interval_violations(dim: DataFrame, key: str) -> DataFrame:
    """key and violation: overlap, gap, uncovered, or a number of current versions other than one; all from one pass over the versions of each key."""
    w = Window.partitionBy(key).orderBy("effective_from")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dim.select(
        key, "effective_from", "effective_to", F.lead("effective_from").over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_first"), F.min("effective_from").over(every).alias("_a"),
        F.max("effective_to").over(every).alias("_b"), F.count_if("is_current").over(every).alias("_n"),
    )
    found = F.array(
        F.when(F.col("_next") < F.col("effective_to"), "overlap"), F.when(F.col("_next") > F.col("effective_to"), "gap"),
        F.when(F.col("_first") & ((F.col("_a") > ntz(FIRST)) | (F.col("_b") < ntz(OPEN_END))), "uncovered"), F.when(F.col("_first") & (F.col("_n") != 1), "current versions"),
    )
    return rows.select(key, F.explode(F.array_compact(found)).alias("violation"))


def as_of(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, ts: Column, columns: dict[str, str], unknown: str = "-1") -> DataFrame:
    """Facts with columns of the version that held at ts (from inclusive, to exclusive); a surrogate without a match is unknown.

    An equi-join on the key with the interval as residual condition.
    """
    v = dim.select(F.col(dim_key).alias("_k"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *(F.col(c).alias(f"_v_{n}") for n, c in columns.items()))
    joined = facts.join(v, (F.col(fact_key) == F.col("_k")) & (ts >= F.col("_from")) & (ts < F.col("_to")), "left")
    first = next(iter(columns))
    out = joined.withColumns({n: F.coalesce(f"_v_{n}", F.lit(unknown)) if n == first else F.col(f"_v_{n}") for n in columns})
    return out.drop("_k", "_from", "_to", *(f"_v_{n}" for n in columns))


def overlapping(left: DataFrame, right: DataFrame, on: str, gap: str = "strict") -> DataFrame:
    """Pairs of versions that overlap, with the intersection as effective_from and effective_to."""
    touch = (lambda a, b: a < b) if gap == "strict" else (lambda a, b: a <= b)
    a, b = left.alias("a"), right.alias("b")
    hit = touch(F.col("a.effective_from"), F.col("b.effective_to")) & touch(F.col("b.effective_from"), F.col("a.effective_to"))
    names = [c for c in right.columns if c not in left.columns]
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & hit).select(
        *(F.col(f"a.{c}").alias(c) for c in left.columns if not c.startswith("effective_")),
        *(F.col(f"b.{c}").alias(c) for c in names),
        F.greatest("a.effective_from", "b.effective_from").alias("effective_from"),
        F.least("a.effective_to", "b.effective_to").alias("effective_to"),
    )
