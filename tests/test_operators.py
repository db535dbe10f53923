"""Operators on small literal tables."""

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardmart.functions import clean
from cardmart.operators import checks, dedup, marts, rolling, scd2, sinks
from cardmart.plans import suite
from cardmart.plans.contract import Contract, GateError, audit, build, build_all, in_order
from cardmart import queries
from cardmart.sources import raw, readers, retail
from cardmart.streaming import rules


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_cleaning(spark):
    amounts = one(spark, ["$1,234.50", "$-77.00", "abc", "", None], clean.currency)
    assert [None if x is None else float(x) for x in amounts] == [1234.5, -77.0, None, None, None]
    codes = ["BAD PIN", "BAD CVV"]
    errors = one(spark, [None, "", "Bad PIN", "Bad PIN, Bad CVV", "Bad PIN,", "Other"], lambda c: clean.code_list(c, codes))
    assert errors == [None, None, ["BAD PIN"], ["BAD PIN", "BAD CVV"], ["BAD PIN"], ["UNKNOWN"]]
    strict = one(spark, ["Bad PIN, Bad CVV"], lambda c: clean.code_list(c, codes, strict=True))
    assert strict == [["BAD PIN", "UNKNOWN"]]
    assert one(spark, ["58523.0", "01234", "12a", " ", None], clean.zip_code) == ["58523", "1234", None, None, None]
    assert one(spark, ["01234.0"], lambda c: clean.zip_code(c, 5)) == ["01234"]
    assert one(spark, ["1234567890123456", "12345", "1234", "12"], clean.masked_pan) == ["************3456", "*2345", "****", "**"]
    assert one(spark, ["12/2022", "13/2019", "", None], clean.month_year) == [dt.date(2022, 12, 1), None, None, None]
    assert one(spark, ["2020-01-02 03:04:05", "x"], clean.timestamp)[1] is None
    assert one(spark, [" true", "FALSE", "x", None], clean.flag) == [True, False, None, None]
    assert one(spark, [5, 0, None], lambda c: clean.safe_ratio(F.lit(1), c), "int") == [0.2, None, None]
    assert one(spark, ["12 Main St"], clean.without_leading_number) == ["Main St"]
    assert one(spark, [70, 30, None], clean.retirement_segment, "int") == ["RETIRED", "WORKING", "UNKNOWN"]
    assert one(spark, [0, 86399, 43200], lambda c: clean.clock_parts(c)["time_24h"], "int") == ["00:00:00", "23:59:59", "12:00:00"]


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_snapshot_and_dimension(spark):
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    s1 = spark.createDataFrame([("A", "x", 1), ("B", None, 1), ("C", "c", 1), ("E", "e", 1)], "id string, t string, u int")
    s2 = spark.createDataFrame([("A", "y", 1), ("B", "v", 1), ("C", "c", 2), ("D", "d", 1)], "id string, t string, u int")
    h1 = scd2.snapshot(None, s1, "id", ["t"], at("2020-01-01"))
    h2 = scd2.snapshot(h1, s2, "id", ["t"], at("2021-01-01"))
    rows = {(r.id, str(r.valid_from)[:4]): (r.t, r.u, r.valid_to) for r in h2.collect()}
    assert set(rows) == {("A", "2020"), ("A", "2021"), ("B", "2020"), ("B", "2021"), ("C", "2020"), ("D", "2021"), ("E", "2020")}
    assert rows["A", "2020"][2] == ts("2021-01-01") and rows["C", "2020"] == ("c", 2, None) and rows["E", "2020"][2] is None
    again = scd2.snapshot(h2, s2, "id", ["t"], at("2021-01-01"))
    assert sorted(map(str, again.collect())) == sorted(map(str, h2.collect()))  # a retry changes nothing
    gap = scd2.snapshot(h1, s2, "id", ["t"], at("2021-01-01"), F.expr("INTERVAL 0.000001 SECOND"))
    assert gap.where("id = 'A' and valid_to is not null").first().valid_to == ts("2020-12-31 23:59:59.999999")
    dim = scd2.dimension(h2, "id", "key")
    assert dim.where("id = '-1'").count() == 1 and scd2.interval_violations(dim, "id").isEmpty()
    events = [("A", "2020-12-31 23:59:59.999999"), ("A", "2021-01-01"), ("A", "1999-01-01"), ("Z", "2021-01-01"), (None, "2021-01-01")]
    facts = spark.createDataFrame([(k, v, ts(t)) for k, (v, t) in enumerate(events)], "k int, id string, ts timestamp_ntz")
    got = [r.t for r in scd2.as_of(facts, dim.withColumnRenamed("id", "dim_id"), "id", "dim_id", F.col("ts"), {"key": "key", "t": "t"}).orderBy("k").collect()]
    assert got == ["x", "y", "x", None, None]


def reissued(spark, n):
    """History of n cards of one brand; every second one has a chip from the start, the others from 1998 on."""
    at = lambda d: F.lit(f"{d} 00:00:00").cast("timestamp_ntz")
    state = spark.range(n).select(F.concat(F.lit("k"), "id").alias("card_id"), F.lit("VISA").alias("card_brand"), (F.col("id") % 2 == 0).alias("has_chip"), F.lit(1).alias("num_cards_issued"))
    first = scd2.snapshot(None, state, "card_id", ["has_chip"], at("1995-01-01"))
    history = scd2.snapshot(first, state.withColumn("has_chip", F.lit(True)), "card_id", ["has_chip"], at("1998-01-01"))
    return scd2.dimension(history, "card_id", "card_key", {"card_brand": "UNKNOWN"})


def portfolio(spark, *more):
    """The portfolio of ten cards with a transaction each on two days, and of others: chip_segment, card_brand, days, issued, active, transactions."""
    days = [dt.date(1996, 1, 1), dt.date(1996, 3, 1)]
    txn = spark.createDataFrame([(c, day, False) for c in [f"k{i}" for i in range(10)] + list(more) for day in days], "card_id string, day date, is_error boolean")
    rows = marts.card_portfolio(txn, reissued(spark, 10)).groupBy("chip_segment", "card_brand").agg(F.count(F.lit(1)), F.max("issued_card_count"), F.max("active_card_count_90d"), F.max("transaction_count_90d"))
    return sorted(map(tuple, rows.collect()))


def test_portfolio_counts_each_card_in_one_version(spark):
    """A card that is reissued in 1998 has no chip in 1996; its second version was taken for a first one, and its transactions counted twice."""
    assert portfolio(spark) == [("CHIP", "VISA", 61, 5, 5, 10), ("NON_CHIP", "VISA", 61, 5, 5, 10)]


def test_portfolio_of_unresolved_cards_counts_each_card_in_one_version(spark):
    """Cards that the dimension does not know are one UNKNOWN segment without active cards; the known ones count as they do without them."""
    assert portfolio(spark, "-1", "gone") == [("CHIP", "VISA", 61, 5, 5, 10), ("NON_CHIP", "VISA", 61, 5, 5, 10), ("UNKNOWN", "UNKNOWN", 61, 0, 0, 4)]


def test_latest_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("a", 2, "r"), ("b", None, "s")], "k string, t int, v string")
    assert sorted(map(tuple, dedup.latest_per_key(df, ["k"], ["t"]).collect())) == [("a", 2, "r"), ("b", None, "s")]
    assert dedup.duplicates(df, ["k"], ["t"], "x").count() == 2


DAYS = st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("cd"), st.integers(0, 40)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(DAYS)
def test_rolling_steps(spark, events):
    """Steps = row frames on a spine = brute force."""
    zero = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(e, c, zero + dt.timedelta(d)) for e, c, d in events], "e string, c string, day date")
    daily = df.groupBy("e", "day").agg(F.count(F.lit(1)).alias("n"))
    end = zero + dt.timedelta(60)
    n = rolling.sum_deltas(daily, ["e"], ["n"], 7).withColumn("u", F.lit(0))
    u = rolling.distinct_deltas(df, ["e"], "c", 7, "u").withColumn("n", F.lit(0))
    steps = rolling.written_out(rolling.steps_from_deltas(n.unionByName(u), ["e"], ["n", "u"]), zero, end)
    got = {(r.e, (r.day - zero).days): (r.n, r.u) for r in steps.collect()}
    bounds = df.groupBy("e").agg(F.min("day").alias("first_day")).withColumn("last_day", F.lit(end))
    dense = rolling.trailing_rows(rolling.densified(rolling.spine(bounds), daily, ["e", "day"], ["n"]), ["e"], "day", {"s": "n"}, 7)
    framed = {(r.e, (r.day - zero).days): r.s for r in dense.collect()}
    for e in {e for e, _, _ in events}:
        for d in range(min(x for y, _, x in events if y == e), 61):
            inside = [c for y, c, x in events if y == e and d - 6 <= x <= d]
            assert got[e, d] == (len(inside), len(set(inside))) and framed[e, d] == len(inside)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, 10, "p"), (2, 10, "q")], "k int, t int, part string")
    sinks.upsert(a, path, ["k"], ["t"])
    sinks.upsert(spark.createDataFrame([(1, 11, "p"), (3, 5, "q")], a.schema), path, ["k"], ["t"])
    assert sorted(r.t for r in spark.read.parquet(path).collect()) == [5, 10, 11]
    parts = str(tmp_path / "p")
    sinks.overwrite_partitions(a, parts, ["part"])
    sinks.overwrite_partitions(a.where("part = 'p'").withColumn("t", F.lit(99)), parts, ["part"])
    sinks.overwrite_partitions(a.where("part = 'p'").withColumn("t", F.lit(99)), parts, ["part"])  # a rerun changes nothing
    assert sorted((r.part, r.t) for r in spark.read.parquet(parts).collect()) == [("p", 99), ("q", 10)]
    sinks.upsert(spark.createDataFrame([(1, 100, "p")], a.schema), parts, ["k"], ["t"], ["part"])
    assert sorted((r.part, r.t) for r in spark.read.parquet(parts).collect()) == [("p", 100), ("q", 10)]
    with pytest.raises(ValueError):
        sinks.write(a, "nonsense", path)
    good, bad = checks.split_mandatory(spark.createDataFrame([(1, "x"), (None, "y"), (None, None)], "a int, b string"), ["a", "b"])
    assert good.count() == 1 and sorted(r._quarantine_null_cols for r in bad.collect()) == ["a", "a, b"]
    sinks.quarantine(bad.withColumn("_quarantine_source", F.lit("s")), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    sinks.merge(spark.createDataFrame([(1, 1, 1)], "k int, c int, u int"), str(tmp_path / "m"), ["k"], ["u"], "c", "u")
    sinks.merge(spark.createDataFrame([(1, 5, 5)], "k int, c int, u int"), str(tmp_path / "m"), ["k"], ["u"], "c", "u")
    assert tuple(spark.read.parquet(str(tmp_path / "m")).first()) == (1, 1, 5)
    assert readers.read_target(spark, str(tmp_path / "none"), a.schema).isEmpty()
    assert not sinks.stamped(a, "2020-01-01 00:00:00", "run", "file").isEmpty()


def test_contract(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string").write.parquet(f"{base}/src")
    ok = Contract("ok", lambda s: s, {"k": "int", "v": "string"}, ("k",), sources=("src",))
    assert build(spark, ok, base, {"src": f"{base}/src"}, audit_path=f"{base}/log").count() == 2
    assert spark.read.parquet(f"{base}/ok").count() == 2 and spark.read.parquet(f"{base}/log").where("not passed").isEmpty()
    bad = Contract("bad", lambda s: s.unionByName(s), {"k": "int", "v": "string"}, ("k",), depends=("ok",))
    with pytest.raises(GateError):
        build(spark, bad, base, {})
    assert not readers.path_exists(spark, f"{base}/bad")


def test_contract_rules_and_order(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(1, 2.5, ts("2024-01-01 10:00:00")), (2, 4.0, ts("2024-01-01 11:00:00")), (3, None, ts("2024-01-01 09:00:00"))], "k int, v double, at timestamp_ntz").write.parquet(f"{base}/src")
    columns = {"k": "int", "v": "double", "at": "timestamp_ntz"}
    loose = Contract("a", lambda s: s.where("k < 3"), columns, ("k",), sources=("src",), row_loss={"src": 40.0}, sums={"src": {"v": 0.01}}, fresh=("at", 60), ranges={"v": (0, 5)}, accepted={"k": (1, 2)})
    rows, src = spark.read.parquet(f"{base}/src").where("k < 3"), {"src": spark.read.parquet(f"{base}/src")}
    told = {n: ok for n, ok, _ in audit(rows, loose, src, ts("2024-01-01 11:30:00"))}
    assert all(told.values()) and {"row_loss_src", "sum_v_src", "fresh", "range_v", "accepted_k"} <= set(told)
    tight = Contract("a", loose.builder, columns, ("k",), row_loss={"src": 10.0}, sums={"src": {"v": 0.0}}, fresh=("at", 10), ranges={"v": (0, 3)}, accepted={"k": (1,)})
    failed = {n for n, ok, _ in audit(rows.where("k = 2"), tight, src, ts("2024-01-01 11:30:00")) if not ok}
    assert failed == {"row_loss_src", "sum_v_src", "fresh", "range_v", "accepted_k"}
    plain = lambda n, f, *needs: Contract(n, f, columns, ("k",), sources=() if needs else ("src",), depends=needs)
    chain = [plain("d", lambda a, b: a, "b", "c"), plain("b", lambda a: a.limit(0), "a"), plain("c", lambda a: a, "a"), plain("a", lambda s: s)]
    assert [c.name for c in in_order(chain)] == ["a", "b", "c", "d"]
    told = build_all(spark, chain, base, {"src": f"{base}/src"})
    assert told["a"] == told["c"] == "published" and told["b"].startswith("failed: b: not_empty") and told["d"] == "skipped: needs b"
    assert readers.path_exists(spark, f"{base}/c") and not readers.path_exists(spark, f"{base}/b")
    with pytest.raises(ValueError, match="depend on each other"):
        in_order([plain("x", None, "y"), plain("y", None, "x")])


def test_suite_scans_each_table_once(spark, tmp_path):
    for name, rows, schema in (("p", [(1,), (2,)], "id int"), ("c", [(1, 5, "x"), (9, 50, "y"), (None, None, "x"), (1, 5, None)], "pid int, v int, s string"), ("e", [], "pid int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in "pce"}
    declared = [*suite.not_null("c", "pid", "s"), suite.between("c", "v", 1, 10), suite.accepted("c", "s", "x"), suite.holds("c", "even", "v % 2 = 0", suite.WARN), suite.unique("c", "pid", "v"),
                suite.refers("c", "pid", "p", "id"), suite.refers("e", "pid", "p", "id"), *suite.not_null("e", "pid")]
    out = suite.results(declared, tables)
    assert {r.check: r.failures for r in out.collect()} == {"c_not_null_pid": 1, "c_not_null_s": 1, "c_between_v": 1, "c_accepted_s": 1, "c_even": 2, "c_unique_pid_v": 1, "c_refers_pid": 1, "e_refers_pid": 0, "e_not_null_pid": 0}
    assert suite.gate(out) == (["c_accepted_s", "c_between_v", "c_not_null_pid", "c_not_null_s", "c_refers_pid", "c_unique_pid_v"], ["c_even"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # the parent, and the list of checks
    assert plan.count("Relation [pid") == 5  # c: columns, key, reference; e: columns, reference
    with pytest.raises(ValueError, match="of one name"):
        suite.results([declared[0], declared[0]], tables)
    with pytest.raises(ValueError, match="unknown check"):
        suite.results([suite.Check("c", "nice", ("v",))], tables).collect()
    past = spark.createDataFrame([("a", k, 10 + k % 2) for k in range(8)] + [("a", 8, 30), ("b", 1, 5), ("b", 2, 50)], "check string, day int, failures long")
    assert [(r.check, r.day) for r in suite.unusual(past).collect()] == [("a", 8)]


def test_star_keeps_rows_and_nulls(spark):
    rows = spark.createDataFrame([("t1", " ab ", "X"), ("t2", None, "y"), ("t3", "zz", None)], "id string, a string, b string")
    dim = spark.createDataFrame([("AB", "x", 7, True), ("ab ", "x", 5, True), ("AB", "x", 1, False), (None, "x", 9, True)], "a string, b string, key int, is_current boolean")
    out = marts.star(rows, [marts.Lookup(dim, ["a", "b"], ["a", "b"], "key")])
    assert sorted((r.id, r.key) for r in out.collect()) == [("t1", 5), ("t2", None), ("t3", None)]


def test_small_checks(spark):
    wide = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    assert sorted(map(tuple, checks.unpivoted(wide).collect())) == [("a", "1"), ("c", "x")]
    assert checks.known_keys(wide, ["a", "c"]).count() == 1 and checks.known_keys(wide, ["b"]).count() == 0
    report = spark.createDataFrame([(20240110, 9), (20240110, 10), (20240109, 9)], "date_key int, window_day_count int")
    assert [(r.date_key, r.window_day_count) for r in checks.incomplete(report, dt.date(2024, 1, 1), 10).collect()] == [(20240110, 9)]
    dim = spark.createDataFrame([("a", True), ("b", False)], "k string, is_current boolean")
    assert [r.k for r in checks.not_current(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), dim, "k").orderBy("k").collect()] == ["b", "c"]
    with pytest.raises(ValueError, match="missing columns: z"):
        checks.require_columns(wide, ["a", "z"])
    one, two = (spark.createDataFrame(r, "d string, v double") for r in ([("d1", 2.0), ("d2", 1.0)], [("d1", 2.0), ("d3", 1.0)]))
    assert {r.d for r in checks.reconciled(one, two, ["d"], ["v"]).collect()} == {"d2", "d3"}


def test_checks(spark):
    a = spark.createDataFrame([("d1", 5), ("d2", 7)], "d string, n int")
    b = spark.createDataFrame([("d1", 5)], "d string, n int")
    assert [r.d for r in checks.reconciled(a, b, ["d"], ["n"]).collect()] == ["d2"]  # a missing partition fails
    assert checks.reconciled(a, a, ["d"], ["n"]).isEmpty()
    assert checks.schema_problems(a, {"d": "string", "n": "bigint", "m": "int"}) == ["missing m", "n is int, not bigint"]
    assert dict(checks.coerced(a, {"n": "bigint", "m": "int"}).dtypes) == {"n": "bigint", "m": "int"}
    assert checks.row_loss(100, 99, 2) is None and checks.row_loss(100, 90, 2) and checks.row_loss(1, 2, 5)
    assert checks.within(100, 101, percent=1) and not checks.within(100, 103, absolute=2)
    with pytest.raises(ValueError):
        checks.check_window(ts("2020-01-01"), ts("2020-01-02"), 5)
    now = ts("2020-01-01 10:00")
    f = spark.createDataFrame([(ts("2020-01-01 09:50"),)], "t timestamp_ntz")
    assert checks.freshness(f, "t", now, 15).isEmpty() and not checks.freshness(f, "t", now, 5).isEmpty()
    with pytest.raises(ValueError):
        marts.safe_rollup(a, ["d"], ["unique_cards"], ["d", "mcc"])
    assert not checks.anomalies(spark.createDataFrame([(k, 10.0 if k < 5 else 99.0) for k in range(6)], "d int, v double"), "d", "v").isEmpty()


def test_holidays(spark):
    days = {r.full_date: r.holiday_name for r in readers.us_holidays(spark.createDataFrame([(2021,)], ["year"])).collect()}
    assert days[dt.date(2021, 11, 25)] == "Thanksgiving Day" and days[dt.date(2021, 7, 5)].endswith("(observed)")
    assert days[dt.date(2021, 12, 31)] == "New Year's Day (observed)" and dt.date(2022, 1, 1) not in days
    assert days[dt.date(2021, 5, 31)] == "Memorial Day" and days[dt.date(2021, 1, 18)].startswith("Martin")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n01;x\n")
    assert readers.read_csv(spark, str(tmp_path), "a.csv", delimiter=";").first().id == "01"
    (tmp_path / "m.json").write_text('{"10": "shop",\n "20": "bar"}')
    wide = readers.read_json(spark, str(tmp_path), "m.json", multiLine=True)
    assert wide.unpivot([], wide.columns, "code", "name").count() == 2
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path), "")
    with pytest.raises(ValueError):
        readers.checked_codes(spark.createDataFrame([("usd",), ("zzz",)], ["c"]), "c", ["USD"])


def test_stream(spark, tmp_path):
    """Six card events inside five minutes against five; one event too late."""
    source = tmp_path / "in"
    base = ts("2024-01-01 10:00:00")
    rows = [("a", base + dt.timedelta(seconds=30 * k)) for k in range(6)] + [("b", base + dt.timedelta(seconds=30 * k)) for k in range(5)]
    schema = "card_id string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame([("c", base + dt.timedelta(hours=2))], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = rules.velocity_stream(stream, "card_id", 5, 5).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.card_id for r in spark.table("hits").collect()} == {"a"}
    twin = rules.velocity(spark.createDataFrame(rows, schema), "card_id", 5, 5)
    assert {r.card_id for r in twin.collect()} == {"a"}


def test_nearest_place(spark):
    """Against all places: far from any cell, across the 180-degree line, near a pole, at the same spot and without coordinates."""
    rnd = random.Random(4)
    places = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(40)] + [(40, 10.0, -179.5), (41, 89.0, 170.0), (42, 10.0, -179.5), (43, None, 5.0)]
    points = [(k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(300)] + [(300, 10.0, 179.5), (301, 88.9, -10.0), (302, 10.0, -179.5), (302, -80.0, 0.0), (303, None, 1.0), (304, -90.0, 7.0)]

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), 6)

    want = sorted((p[0], -1 if p[1] is None else min((km(p, q), q[0]) for q in places if q[1] is not None)[1]) for p in points)
    p, q = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "place int, plat double, plon double")
    for cell in (2.0, 20.0):
        assert sorted((r.id, -1 if r.place is None else r.place) for r in marts.nearest_place(p, q, cell).collect()) == want
    assert {r.place for r in marts.nearest_place(p, q.limit(0)).collect()} == {None}


def test_points_on_the_empty_side_meet_few_cubes(spark):
    """2,000 places on one side, 200 points on the other: each point meets a few cubes of the tree, not all places."""
    rnd = random.Random(9)
    q = spark.createDataFrame([(k, rnd.uniform(-40, 40), rnd.uniform(-40, 40)) for k in range(2000)], "place int, plat double, plon double")
    p = spark.createDataFrame([(k, rnd.uniform(-30, 30), rnd.uniform(150, 180)) for k in range(200)], "id int, lat double, lon double")
    side = 2 * math.sin(math.radians(2.0) / 2)
    met = marts.descended(p.select("lat", "lon"), q, side).groupBy("lat", "lon").count()
    assert met.count() == 200 and met.agg(F.avg("count"), F.max("count")).first()[0] < 40
    every = p.crossJoin(q).withColumn("km", marts.haversine_km()).groupBy("id").agg(F.min(F.struct("km", "place")).alias("b")).select("id", "b.place")
    assert sorted(map(tuple, marts.nearest_place(p, q).select("id", "place").collect())) == sorted(map(tuple, every.collect()))


def test_batch_day_range_reaches_the_scan(spark):
    """One-day reports read the window's days only: the lower bound is pushed to the file scan, the upper is a literal filter."""
    sf = "/root/testdata/sf0.001"
    for name, first in (("customer_activity_one_day", "1999-11-03"), ("card_portfolio_one_day", "1999-11-03"), ("merchant_error_one_day", "2000-01-02")):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert f"GreaterThanOrEqual(l_shipdate,{first}T00:00" in plan, name
        assert "< 2000-02-01" in plan, name


def test_reports_of_unresolved_cards_add_up(spark):
    """Every transaction of the window is in the portfolio, whatever became of its card."""
    sf = "/root/testdata/sf0.001"
    inside = marts.trailing_window(retail.transactions(spark, sf), queries.BATCH, 90).count()
    got = queries.QUERIES["card_portfolio_unresolved_one_day"](spark, sf).agg(F.sum("transaction_count_90d")).first()[0]
    assert got == inside > 0


def test_raw_projections(spark):
    txn = [("1", "2019-10-31 10:00:00", "7", "8", "$-77.00", "Swipe Transaction", "9", " Paris ", "tx", "58523.0", "5411", "Bad PIN,Odd"), ("2", "bad", "7", "8", "abc", "?", "9", None, None, "12a", None, None)]
    rows = raw.transactions(spark.createDataFrame(txn, "id string, date string, client_id string, card_id string, amount string, use_chip string, merchant_id string, merchant_city string, merchant_state string, zip string, mcc string, errors string"), ["BAD PIN"]).collect()
    assert rows[0].merchant_city == "paris" and rows[0].merchant_state == "TX" and rows[0].zip == "58523" and rows[0].errors == ["BAD PIN", "UNKNOWN"] and rows[0].day == 31 and str(rows[0].amount) == "-77.00"
    assert rows[1].timestamp is None and rows[1].amount is None and rows[1].transaction_channel is None and rows[1].zip is None and not rows[1].is_error
    card = [("1", "2", "Visa", "Debit", "4111111111111111", "12/2022", "123", "YES", "2", "$1,234.50", "13/2019", "1989", "No")]
    c = raw.cards(spark.createDataFrame(card, "id string, client_id string, card_brand string, card_type string, card_number string, expires string, cvv string, has_chip string, num_cards_issued string, credit_limit string, acct_open_date string, year_pin_last_changed string, card_on_dark_web string")).first()
    assert c.mask_card_number == "*" * 12 + "1111" and str(c.expires) == "2022-12-01" and c.has_chip and c.has_a_cvv and c.acct_open_date is None and c.year_pin_last_changed is None and c.card_on_dark_web is False and "card_number" not in c.asDict()
    user = [("5", "40", "66", "1980", "13", "Male", "48.9", "2.3", "$10", "$20", "$30", "900", "3"), ("6", "40", "40", "1980", "2", "x", "far", "2.3", "$10", "$20", "$30", "700", "3")]
    where = spark.createDataFrame([(("Paris", "FR"), 48.8, 2.35), (("Rome", "IT"), 41.9, 12.5)], "place struct<city:string,state:string>, plat double, plon double")
    u = {r.user_id: r for r in raw.users(spark.createDataFrame(user, "id string, current_age string, retirement_age string, birth_year string, birth_month string, gender string, latitude string, longitude string, per_capita_income string, yearly_income string, total_debt string, credit_score string, num_credit_cards string"), where).collect()}
    assert u["5"].city == "Paris" and u["5"].birth_month is None and u["5"].credit_score is None and u["5"].gender == "MALE" and u["6"].city is None and u["6"].retirement_age is None and "current_age" not in u["5"].asDict()


def test_change_feed_and_publish_modes(spark, tmp_path):
    feed = spark.createDataFrame([("a", 1, "I", 1), ("a", 2, "U", 2), ("b", 1, "I", 1), ("b", 9, "D", 3)], "id string, v int, op string, seq int")
    state, gone = raw.latest_changes(feed, ["id"], ["seq"])
    assert [(r.id, r.v) for r in state.collect()] == [("a", 2)] and [r.id for r in gone.collect()] == ["b"]
    path = str(tmp_path / "newer")
    for values in ([(1, ts("2020-01-01"))], [(2, ts("2020-01-01")), (3, ts("2020-01-02"))]):
        sinks.write(spark.createDataFrame(values, "k int, t timestamp_ntz").coalesce(1), "append_newer", path, ts="t")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    path = str(tmp_path / "history")
    for values, at in (([("a", 1), ("b", 1)], "2020-01-01 00:00:00"), ([("a", 2), ("b", 1)], "2020-02-01 00:00:00"), ([("a", 2), ("b", 1)], "2020-03-01 00:00:00")):
        sinks.write(spark.createDataFrame(values, "k string, v int"), "scd2", path, key="k", tracked=["v"], at=at)
    rows = sorted((r.k, r.version_number, r.v, r.valid_to is None) for r in spark.read.parquet(path).collect())
    assert rows == [("a", 1, 1, False), ("a", 2, 2, True), ("b", 1, 1, True)]


def streamed(spark, tmp_path, rows, schema, job, name):
    """What a streaming job emits for rows that come in one file, after a row far later has closed all windows."""
    source = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    late = [tuple(v + dt.timedelta(days=2) if isinstance(v, dt.datetime) else "zz" if isinstance(v, str) else v for v in rows[-1])]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    q = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_rule_streams(spark, tmp_path):
    base = ts("2024-01-01 10:00:00")
    schema = "customer_id string, card_id string, merchant_id string, mcc string, amount double, is_error boolean, state string, ts timestamp"
    at = lambda k: base + dt.timedelta(seconds=40 * k)
    rows = [("c", "k", f"m{i}", "1", 10.0 * (i + 1), i == 0, f"s{i % 2}", at(i)) for i in range(5)]
    counts = streamed(spark, tmp_path, rows, schema, rules.five_minute_counts, "counts")
    assert {(r.merchant_id, r.n, r.failed) for r in counts if r.merchant_id == "m0"} == {("m0", 1, 1)}
    spread = streamed(spark, tmp_path, rows, schema, lambda s: rules.spread_stream(s, "customer_id", "merchant_id", 3, 5), "spread")
    assert spread and all(r.customer_id == "c" and r.n > 3 for r in spread)
    states = streamed(spark, tmp_path, rows, schema, lambda s: rules.spread_stream(s, "card_id", "state", 1, 30), "states")
    assert {r.card_id for r in states} == {"k"}
    profile = spark.createDataFrame([("c", 35.0, 50.0, "s0", ["2"])], "customer_id string, p95_amount double, credit_limit double, home string, categories array<string>")
    want = {"AR002": 2, "AR003": 1, "GR002": 2, "BR002": 5}
    for rule, n in want.items():
        got = streamed(spark, tmp_path, rows, schema, lambda s, r=rule: rules.against(s, profile, "customer_id", r), f"rule_{rule}")
        twin = rules.against(spark.createDataFrame(rows, schema), profile, "customer_id", rule).count()
        assert len(got) == twin == n, rule
    profile = spark.createDataFrame([("c", 10.0, 50.0, ["s0"])], "customer_id string, mean_amount double, daily_mean double, states array<string>")
    for rule, n in {"AR001": 2, "GR003": 2}.items():
        assert len(streamed(spark, tmp_path, rows, schema, lambda s, r=rule: rules.against(s, profile, "customer_id", r), f"rule_{rule}")) == n, rule
    for factor, n in ((2.9, 1), (3.0, 0)):  # 150 on the day, 50 as a rule
        spent = streamed(spark, tmp_path, rows, schema, lambda s, f=factor: rules.spending_stream(s, profile, f), f"spending_{n}")
        assert [r.spent for r in spent] == [150.0] * n
    busy = [("c", f"k{i}", "m", "1", 1.0, i < 2, "s", base + dt.timedelta(seconds=20 * i)) for i in range(7)]
    past = [("c", f"k{i}", "m", "1", 1.0, i == 0, "s", base - dt.timedelta(days=1, minutes=5 * i)) for i in range(3)]
    seen = spark.createDataFrame(past, schema)
    hits = streamed(spark, tmp_path, busy, schema, lambda s: rules.merchant_stream(s, rules.merchant_profile(seen)), "merchants")
    assert [(r.n, r.failed, r.MR001, r.MR002) for r in hits] == [(7, 2, True, False)]  # three buckets of one, a third failed
    hits = streamed(spark, tmp_path, busy, schema, lambda s: rules.merchant_stream(s, rules.merchant_profile(seen), 9.0, 0.8), "failures")
    assert [(r.MR001, r.MR002) for r in hits] == [(False, True)]
    fresh = streamed(spark, tmp_path, busy, schema, lambda s: rules.new_card_stream(s, seen), "fresh")
    assert [(r.cards, r.new_cards) for r in fresh] == [(7, 4)]
    usual = spark.createDataFrame([("c", 10, 1.0)], "customer_id string, hour int, usual double")
    pattern = streamed(spark, tmp_path, rows, schema, lambda s: rules.unusual_pattern_stream(s, usual), "pattern")
    assert [(r.customer_id, r.n) for r in pattern] == [("c", 5)]


def test_cleaning_helpers(spark):
    row = spark.createDataFrame([(" Ab ", "x", 20240229)], "a string, b string, k int").select(
        clean.lower_trim(F.col("a")).alias("low"), clean.short_key(F.col("b")).alias("s"), clean.short_md5_key(F.col("b")).alias("m"), clean.key_date(F.col("k")).alias("d"), clean.days_in_month(clean.key_date(F.col("k"))).alias("n")
    ).first()
    assert row.low == "ab" and 1 <= row.s <= 32767 and 1 <= row.m <= 32767 and row.d == dt.date(2024, 2, 29) and row.n == 29
    df = spark.createDataFrame([(1,)], ["y"])
    assert df.select(checks.first_column(df, ["x", "y"]).alias("v")).first().v == 1 and df.select(checks.first_column(df, ["x"]).alias("v")).first().v is None
    with pytest.raises(ValueError):
        checks.first_column(df, ["x"], required=True)
    with pytest.raises(ValueError):
        rolling.bounds(spark.createDataFrame([], "day date"))
