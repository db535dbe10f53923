"""Histories, kept window states and change feeds against plain loops over all orders."""

import datetime as dt
import gzip
import itertools
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cardmart.operators import marts, scd2, sinks
from cardmart.operators.window_state import KeptState, TrailingState
from cardmart.streaming import feed

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


# histories


def plain_history(batches):
    """(key, tracked, loose, from, to, number) of the sorted observations; batches: {time: [(key, tracked, loose)]}, later deliveries win."""
    out = []
    for key in sorted({r[0] for rows in batches.values() for r in rows}):
        seen = sorted((at, max(r[1:] for r in rows if r[0] == key)) for at, rows in batches.items() if any(r[0] == key for r in rows))
        versions = []
        for at, (tracked, loose) in seen:
            if versions and versions[-1][1] == tracked:
                versions[-1][2] = loose
            else:
                versions.append([key, tracked, loose, at])
        for k, v in enumerate(versions):
            out.append((*v, versions[k + 1][3] if k + 1 < len(versions) else None, k + 1))
    return out


BATCHES = {
    "2024-01-01 00:00:00": [("a", 1, 10), ("b", 1, 10), ("d", 5, 1)],
    "2024-02-01 00:00:00": [("a", 2, 20), ("b", 1, 20), ("c", 7, 1), ("a", 2, 21)],
    "2024-03-01 00:00:00": [("a", 1, 30), ("b", 1, 30), ("c", 7, 2)],
    "2024-04-01 00:00:00": [("a", 1, 40), ("b", 3, 40), ("c", None, 3)],
    "2024-05-01 00:00:00": [("a", 2, 50), ("b", 3, 50), ("c", 7, 4), ("c", 7, 3), ("d", 5, 2)],
}
COLUMNS = ["k", "v", "w", "valid_from", "valid_to", "version_number"]


def versions_of(df):
    return sorted((tuple(None if x is None else str(x) if isinstance(x, dt.datetime) else x for x in r) for r in df.select(*COLUMNS).collect()), key=str)


def plain_ordered():
    """The plain history with a null tracked value, which sorts below numbers."""
    low = {at: [(k, -1 if v is None else v, w) for k, v, w in rows] for at, rows in BATCHES.items()}
    return sorted(((k, None if v == -1 else v, *rest) for k, v, *rest in plain_history(low)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_batches_in_any_order_give_one_history(spark, tmp_path, seed):
    rnd = random.Random(seed)
    order = rnd.sample(sorted(BATCHES), len(BATCHES)) if seed else sorted(BATCHES)
    order += [order[1], order[-1]]  # deliveries that are repeated
    path = str(tmp_path / "history")
    for at in order:
        sinks.write(spark.createDataFrame(BATCHES[at], "k string, v int, w int").coalesce(1), "scd2", path, key="k", tracked=["v"], at=at)
    found = spark.read.parquet(path)
    assert versions_of(found) == plain_ordered()
    assert os.listdir(tmp_path) == ["history"]  # no staging folder stays
    dim = scd2.dimension(found.drop("version_number", "seen"), "k", "key")
    assert scd2.interval_violations(dim.where("k NOT IN ('-1', '-2')"), "k").isEmpty()


def test_all_orders_of_one_key(spark):
    rows = {f"2024-0{m}-01 00:00:00": [("a", v, m)] for m, v in ((1, 1), (2, 2), (3, 1), (4, 1))}
    frames = {at: spark.createDataFrame(r, "k string, v int, w int").cache() for at, r in rows.items()}
    for order in list(itertools.permutations(rows))[::7]:
        out = None
        for at in order:
            out = sinks.written(scd2.published(out, frames[at], "k", ["v"], F.lit(at).cast("timestamp_ntz")), "history")
        assert versions_of(out) == sorted(plain_history(rows), key=str), order


def test_late_batches_can_be_ignored(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, w int")
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    out = scd2.published(None, frame([("a", 1, 1)]), "k", ["v"], at("2024-01-01"))
    out = scd2.published(out, frame([("a", 2, 2)]), "k", ["v"], at("2024-06-01"))
    before = versions_of(out)
    out = scd2.published(out, frame([("a", 9, 9), ("b", 4, 4)]), "k", ["v"], at("2024-03-01"), late="ignore")
    assert versions_of(out) == [*before, ("b", 4, 4, "2024-03-01 00:00:00", None, 1)]
    with pytest.raises(ValueError):
        scd2.published(out, frame([]), "k", ["v"], at("2024-03-01"), late="drop")
    late = scd2.snapshot(out.drop("version_number", "seen"), frame([("a", 9, 9)]), "k", ["v"], at("2024-03-01"))
    assert sorted((r.v, r.w) for r in late.where("k = 'a'").collect()) == [(1, 1), (2, 2)]


def test_settled_history_keeps_its_versions(spark):
    out = None
    for at, rows in sorted(BATCHES.items()):
        out = sinks.written(scd2.published(out, spark.createDataFrame(rows, "k string, v int, w int"), "k", ["v"], F.lit(at).cast("timestamp_ntz")), "history")
    short = scd2.settled(out, F.lit("2024-04-15 00:00:00").cast("timestamp_ntz"))
    assert versions_of(short) == plain_ordered()
    assert max(r.n for r in short.select(F.size("seen").alias("n")).collect()) < max(r.n for r in out.select(F.size("seen").alias("n")).collect())


def test_a_failed_swap_leaves_the_target(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), sinks._rename
    sinks.replace(spark.createDataFrame([(1,)], "k int"), path)
    for fails in (1, 2):
        calls = []

        def rename(fs, a, b, fails=fails, calls=calls):
            calls.append(a)
            if len(calls) == fails:
                raise OSError("no")
            real(fs, a, b)

        monkeypatch.setattr(sinks, "_rename", rename)
        with pytest.raises(OSError):
            sinks.replace(spark.createDataFrame([(2,)], "k int"), path)
        monkeypatch.setattr(sinks, "_rename", real)
        assert [r.k for r in spark.read.parquet(path).collect()] == [1] and os.listdir(tmp_path) == ["t"]
    os.rename(path, f"{path}.old-1")  # as if the process had ended between the renames
    sinks.upsert(spark.createDataFrame([(3,)], "k int"), path, ["k"], [])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]


# kept window states


@pytest.fixture(scope="module")
def facts(spark):
    rnd = random.Random(3)
    rows = [(f"e{rnd.randrange(12)}", rnd.choice([None, *(f"i{k}" for k in range(5))]), day(rnd.randrange(70)), rnd.randrange(1, 9)) for _ in range(600)]
    rows += [("once", "i0", day(2), 1)]
    return rows, spark.createDataFrame(rows, "e string, i string, day date, n long").cache()


def plain_state(rows, at, days):
    out = {}
    for e in {r[0] for r in rows if r[2] <= at}:
        mine = [r for r in rows if r[0] == e and r[2] <= at]
        inside = [r for r in mine if r[2] > at - dt.timedelta(days=days)]
        out[e] = (sum(r[3] for r in inside), len({r[1] for r in inside} - {None}), max(r[2] for r in mine))
    return out


def test_thirty_days_rolled_one_by_one(spark, facts, tmp_path):
    rows, df = facts
    kept = KeptState(TrailingState(["e"], ["n"], 14, "i", "items"), str(tmp_path))
    kept.build(df, day(30))
    for k in range(31, 61):
        totals = kept.roll(df, day(k))
        if k % 5 == 0 or k == 31:
            assert {r.e: (r.n, r["items"], r.last_day) for r in totals.collect()} == plain_state(rows, day(k), 14)
    names, want = totals.columns, sorted(map(tuple, totals.collect()))
    full = kept.what.build(df, day(60))[0]
    assert sorted(map(tuple, full.select(*names).collect())) == want
    again = kept.roll(df, day(60))  # a day that runs again
    assert sorted(map(tuple, again.select(*names).collect())) == want
    with pytest.raises(ValueError):
        kept.roll(df, day(90))


def test_a_step_reads_two_days_and_the_state(spark, facts, tmp_path):
    path = str(tmp_path / "facts")
    facts[1].repartition("day").write.partitionBy("day").parquet(path)
    kept = KeptState(TrailingState(["e"], ["n"], 14, "i"), str(tmp_path / "state"))
    stored = spark.read.parquet(path)
    kept.build(stored, day(40))
    totals, _ = kept.what.advance(*kept.of(spark, day(40)), stored, day(41))
    scans = [x for x in totals._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "/facts" in x]
    dates = {d for x in scans for d in re.findall(r"\(day#\d+ = ([\d-]+)\)", x)}
    assert scans and all("(day#" in x for x in scans) and dates == {str(day(41)), str(day(27))}


# change feeds

FEED = "id string, v int, lsn long, deleted_at string, _corrupt_record string"


def put(root, when, name, lines):
    folder = f"{root}/people/year={when:%Y}/month={when:%m}/day={when:%d}"
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/{name}.jsonl.gz", "wt") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def change(i, v, lsn, deleted=None):
    return {"id": i, "v": v, "lsn": lsn, "deleted_at": deleted}


ARRIVALS = [
    (day(0), [change("a", 1, 1), change("b", 1, 2), change("c", 1, 3), "no json", change(None, 5, 4)]),
    (day(1), [change("a", 2, 10), change("b", 1, 11, "2024-01-02"), change("c", 3, 13), change("c", 2, 12)]),
    (day(1), [change("b", 9, 5), change("d", 1, 20), change("a", 1, 1)]),  # late: older than the deletion and than the last change
    (day(2), [change("d", 1, 21, "2024-01-03"), change("d", 2, 22), change("e", 1, 23, "2024-01-03")]),
]
STATE = {"a": 2, "c": 3, "d": 2}


def table(path):
    return feed.ChangeTable(path, ["id"], ["lsn"], "deleted_at IS NOT NULL", buckets=4)


def state_of(t, spark):
    return {r.id: r.v for r in t.state(spark, spark.createDataFrame([], FEED).schema).collect()}


def test_change_feed_in_micro_batches(spark, tmp_path):
    root, t = str(tmp_path / "bronze"), table(str(tmp_path / "state"))
    for k, (when, lines) in enumerate(ARRIVALS):
        put(root, when, f"part-{k}", lines)
        query = t.start(feed.change_stream(spark, root, "people", FEED, 1), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    assert state_of(t, spark) == STATE
    rows = t.rows(spark, spark.createDataFrame([], FEED).schema)
    assert {r.id for r in rows.where("deleted_at IS NOT NULL").collect()} == {"b", "e"}
    whole = table(str(tmp_path / "whole"))  # all at once
    whole.apply(feed.changes(spark, root, "people", FEED), 0)
    assert state_of(whole, spark) == STATE
    rejected = spark.read.parquet(str(tmp_path / "whole" / "rejected"))
    assert sorted(str(r._corrupt_record) for r in rejected.collect()) == ["None", "no json"]
    query = t.start(feed.change_stream(spark, root, "people", FEED, 1), str(tmp_path / "checkpoint"))
    query.awaitTermination()  # nothing new
    assert state_of(t, spark) == STATE


def test_change_batches_replayed_and_broken_off(spark, tmp_path, monkeypatch):
    t = table(str(tmp_path / "state"))
    frames = [spark.createDataFrame([(x["id"], x["v"], x["lsn"], x["deleted_at"], None) for x in lines if isinstance(x, dict)], FEED) for _, lines in ARRIVALS]
    assert t.apply(frames[0], 0) and t.apply(frames[1], 1)
    assert not t.apply(frames[1], 1) and not t.apply(frames[0], 0)  # replays
    before = t._numbers(spark, "manifest")
    real = spark.createDataFrame

    def dies(*a, **b):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(spark), "createDataFrame", dies)  # after the data, before the manifest
    with pytest.raises(RuntimeError):
        t.apply(frames[2], 2)
    monkeypatch.undo()
    assert real and t._numbers(spark, "manifest") == before
    assert t.apply(frames[2], 2) and t.apply(frames[3], 3)
    assert state_of(t, spark) == STATE
    assert t.apply(real([("z", 1, 99, None, None)], FEED), 0, "other")  # another source counts its own batches
    assert state_of(t, spark) == STATE | {"z": 1}
    assert t.vacuum(spark) > 0
    assert state_of(t, spark) == STATE | {"z": 1}
    assert len(t._numbers(spark, "manifest")) == 2


def test_change_table_without_rows(spark, tmp_path):
    t = table(str(tmp_path / "state"))
    assert state_of(t, spark) == {}
    assert t.apply(spark.createDataFrame([], FEED), 0) and state_of(t, spark) == {}
    assert t.vacuum(spark) == 0


def test_state_facts_name_unknown_cards(spark):
    txn = spark.createDataFrame([("c", "-1", "m", "x", DAY, -5, True), ("-1", "k", "m", "x", DAY, 5, False)], "customer_id string, card_id string, merchant_id string, mcc string, day date, amount int, is_error boolean")
    assert [tuple(r) for r in marts.state_facts(txn, marts.ACTIVITY).collect()] == [("c", None, DAY, 1)]
    assert sorted(r.card_id for r in marts.state_facts(txn, marts.PORTFOLIO).collect()) == ["-1", "k"]
    assert sorted((r.failed, r.spend) for r in marts.state_facts(txn, marts.MERCHANTS).collect()) == [(0, 0), (1, 5)]
