"""Exact stream rules, snapshots, moving profiles and sketches against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cardmart.operators import sketches
from cardmart.streaming import exact, profiles, rules

START = dt.datetime(2024, 1, 1, 10)
SCHEMA = "transaction_id string, customer_id string, card_id string, merchant_id string, mcc string, amount double, is_error boolean, state string, ts timestamp"


def transactions(seed, n=160, minutes=120):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        c = rnd.randrange(4)
        at = START + dt.timedelta(seconds=rnd.choice([rnd.randrange(minutes * 60), 60 * rnd.randrange(minutes)]), microseconds=rnd.choice([0, 1, 999_999]))
        out.append((f"t{k}", f"c{c}", f"c{c}-{rnd.randrange(2)}", rnd.choice(["m0", "m1", "m2", None]), str(rnd.randrange(5)), float(rnd.randrange(-100, 100)), rnd.random() < 0.2, f"s{rnd.randrange(3)}", at))
    return out


@pytest.fixture
def store(spark):
    before = spark.conf.get(exact.STORE[0])
    spark.conf.set(*exact.STORE)
    yield
    spark.conf.set(exact.STORE[0], before)


def fed(spark, tmp_path, rows, job, name, files=3, schema=SCHEMA):
    """What a job emits for rows that arrive in files in a shuffled order, after a row far later has moved the watermark past them."""
    source = str(tmp_path / f"in-{name}")
    rows = random.Random(1).sample(rows, len(rows))
    late = list(rows[0])
    late[0], late[-1] = "late", START + dt.timedelta(days=3)
    for part in [*(rows[k::files] for k in range(files)), [tuple(late)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"check-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).where("transaction_id <> 'late'") if "transaction_id" in spark.table(name).columns else spark.table(name)


@pytest.mark.parametrize(("name", "key", "most", "minutes"), [("vr001", "card_id", 2, 5), ("vr002", "customer_id", 4, 10)])
def test_velocity_stream_names_what_its_twin_names(spark, tmp_path, store, name, key, most, minutes):
    rows = transactions(most)
    got = fed(spark, tmp_path, rows, lambda s: exact.velocity(s, key, most, minutes, "4 hours"), name)
    twin = rules.velocity(spark.createDataFrame(rows, SCHEMA), key, most, minutes)
    want = sorted((r.transaction_id, r.n, r[key], r.ts, r.amount, r.merchant_id) for r in twin.collect())
    assert want and sorted((r.transaction_id, r.n, r[key], r.ts, r.amount, r.merchant_id) for r in got.collect()) == want


@pytest.mark.parametrize(("name", "key", "item", "most", "minutes"), [("vr003", "customer_id", "merchant_id", 2, 10), ("gr001", "card_id", "state", 1, 30)])
def test_spread_stream_names_what_its_twin_names(spark, tmp_path, store, name, key, item, most, minutes):
    rows = transactions(7 + most)
    got = fed(spark, tmp_path, rows, lambda s: exact.spread(s, key, item, most, minutes, "4 hours"), name)
    want = sorted((r.transaction_id, r.n) for r in rules.spread(spark.createDataFrame(rows, SCHEMA), key, item, most, minutes).collect())
    assert want and sorted((r.transaction_id, r.n) for r in got.collect()) == want


def test_state_keeps_the_window_alone():
    """A key's state after a timer: what a later window still reaches, and what waits."""
    held = {}

    class List:
        def get(self):
            return iter(held.get("rows", []))

        def put(self, rows):
            held["rows"] = rows

        def clear(self):
            held["rows"] = []

        def appendList(self, rows):
            held.setdefault("rows", []).extend(rows)

    class Handle:
        timers: set = set()

        def getListState(self, name, schema):
            return List()

        def listTimers(self):
            return iter(sorted(self.timers))

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.discard(t)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 100_000

    p = exact._Trailing(None, "k", [], 1, 30_000_000, False)
    p.init(Handle())
    held["rows"] = [(us, False, None) for us in (10_000_000, 65_000_000, 80_000_000, 100_000_000, 120_000_000)]
    hits = [df for df in p.handleExpiredTimer(("k",), Now(), None) if len(df)]
    assert hits[0]["n"].tolist() == [2, 2]
    assert [(e[0], e[1]) for e in held["rows"]] == [(80_000_000, True), (100_000_000, True), (120_000_000, False)]
    assert list(Handle().listTimers()) == [120_001]


def test_snapshot_of_chained_streams(spark, tmp_path, store):
    rows = transactions(3, 120)

    def job(s):
        base = s.withWatermark("ts", "4 hours")
        hits = {"VR001": exact.velocity(s, "card_id", 2, 10, "4 hours"), "VR003": exact.spread(s, "customer_id", "merchant_id", 2, 10, "4 hours")}
        return rules.operations_snapshot(base, hits, 80.0)

    got = fed(spark, tmp_path, rows, job, "snapshot")
    t = spark.createDataFrame(rows, SCHEMA)
    want = rules.operations_snapshot(t, {"VR001": rules.velocity(t, "card_id", 2, 10), "VR003": rules.spread(t, "customer_id", "merchant_id", 2, 10)}, 80.0)
    assert {r.rule for r in want.select("rule").distinct().collect()} == {"ALL", "VR001", "VR003"}
    assert sorted(map(str, got.where(F.col("window_start") < F.lit(START + dt.timedelta(days=1))).collect())) == sorted(map(str, want.collect()))


def test_profile_moves_between_micro_batches(spark, tmp_path):
    at = lambda d, k=0: START + dt.timedelta(days=d, seconds=k)
    row = lambda i, amount, state, mcc, ts: (i, "c", "c-0", "m", mcc, amount, False, state, ts)
    batches = [
        [row("a1", 10.0, "s0", "1", at(0)), row("a2", 20.0, "s0", "1", at(0, 5))],
        [row("b1", 50.0, "s1", "1", at(1)), row("b2", 30.0, "s0", "2", at(1, 5))],  # b1: above 3 x 15, a new state; b2: a new category
        [row("d1", 50.0, "s1", "2", at(2))],  # by now usual: the mean is 27.5
    ]
    source = str(tmp_path / "in")
    kept = profiles.KeptProfile(str(tmp_path / "profile"), ["customer_id"], buckets=4)
    asked = ["AR001", "GR003", "BR002"]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = kept.start(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "check"), asked)
        q.awaitTermination()
        assert q.exception() is None
    found = sorted((r.commit, r.rule, r.transaction_id) for r in kept.hits(spark).collect())
    assert found == [(1, "AR001", "b1"), (1, "BR002", "b2"), (1, "GR003", "b1")]
    frame = spark.createDataFrame(batches[2], SCHEMA)
    assert not kept.apply(frame, 2, asked)  # a replay changes nothing
    p = kept.profile(frame).first()
    assert (p.mean_amount, p.daily_mean, p.daily_count, sorted(p.categories), sorted(p.states)) == (32.0, 160 / 3, 5 / 3, ["1", "2"], ["s0", "s1"])
    whole = profiles.usual(profiles.parts(spark.createDataFrame(sum(batches, []), SCHEMA), "customer_id")).first()
    assert (whole.mean_amount, whole.daily_mean, whole.failure_rate, whole.p95_amount) == (p.mean_amount, p.daily_mean, p.failure_rate, p.p95_amount)
    with pytest.raises(ValueError):
        kept.apply(frame, 3, ["nonsense"])


def test_profile_of_no_history(spark, tmp_path):
    kept = profiles.KeptProfile(str(tmp_path / "p"), ["customer_id"])
    frame = spark.createDataFrame(transactions(1, 20), SCHEMA)
    assert kept.hits(spark) is None and kept.profile(frame).count() == 0
    assert kept.apply(frame, 0, ["AR001"]) and kept.hits(spark).count() == 0
    assert kept.profile(frame).count() == 4


def test_merged_sketches(spark):
    rnd = random.Random(5)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(40)), rnd.choice("xy"), f"k{rnd.randrange(3000)}", rnd.gauss(0, 100)) for _ in range(30_000)]
    df = spark.createDataFrame([*rows, (dt.date(2024, 1, 1), "x", None, None)], "day date, seg string, card string, v double").repartition(7)
    by_day = sketches.daily(df, ["seg"], ["card"], ["v"]).cache()
    direct = sketches.estimated(sketches.daily(df.withColumn("day", F.lit(1)), ["seg"], ["card"], ["v"]), ["seg"], ["card"], {"v": [0.5, 0.95]})
    merged = sketches.merged(by_day, ["seg"], ["card"], ["v"])
    got = {r.seg: r for r in sketches.estimated(merged, ["seg"], ["card"], {"v": [0.5, 0.95]}).collect()}
    for r in direct.collect():
        mine = [x for x in rows if x[1] == r.seg]
        assert got[r.seg].n == len(mine) + (r.seg == "x")
        for n in (r.unique_card, got[r.seg].unique_card):  # direct and merged
            assert abs(n / len({x[2] for x in mine}) - 1) < 4 * 1.04 / 2 ** (sketches.LOG / 2)
        values = sorted(x[3] for x in mine)
        for q, name in ((0.5, "v_p50"), (0.95, "v_p95")):
            assert abs(sum(x <= got[r.seg][name] for x in values) / len(values) - q) < 2 * sketches.RANK_ERROR
    by_month = sketches.merged(by_day.withColumn("month", F.month("day")), ["month", "seg"], ["card"], ["v"])
    twice = sketches.estimated(sketches.merged(by_month, ["seg"], ["card"], ["v"]), ["seg"], ["card"], {})
    assert {(r.seg, r.n, r.unique_card) for r in twice.collect()} == {(r.seg, r.n, r.unique_card) for r in got.values()}  # whatever the steps
    days = [dt.date(2024, 1, 20), dt.date(2024, 2, 5)]
    windows = sketches.estimated(sketches.trailing(by_day, [], ["card"], ["v"], days, 7), ["window_end"], ["card"], {})
    for r in windows.collect():
        inside = [x for x in rows if dt.timedelta(0) <= r.window_end - x[0] < dt.timedelta(days=7)]
        assert r.n == len(inside) and abs(r.unique_card / len({x[2] for x in inside}) - 1) < 4 * 1.04 / 2 ** (sketches.LOG / 2)
    half = merged.select("seg", sketches.rank("v", F.lit(0.0)).alias("r")).collect()
    assert all(abs(x.r - 0.5) < 0.03 for x in half)
