"""The reports and joins of larger tables: ranges instead of rows, tasks that do not grow."""

import datetime as dt
import random
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from cardmart import queries
from cardmart.operators import marts, scd2
from cardmart.sources import retail


def test_activity_totals_are_the_sums_of_the_rows(spark):
    """Gaps of 89, 90 and 91 days, two cards, a lost card, an unknown customer, one without a version."""
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", "a1", d(0)), ("a", "a1", d(89)), ("a", "a2", d(89)), ("a", "-1", d(179)), ("a", None, d(270)), ("b", "b1", d(3)), ("b", "b1", d(3)), ("b", "b1", d(93)), ("-1", "x", d(300)), ("c", "c1", d(5))]
    txn = spark.createDataFrame(rows, "customer_id string, card_id string, day date")
    at = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(days=x)
    dim = spark.createDataFrame([("a", "k1", at(-9), at(40), 1), ("a", "k2", at(40), at(9999), 2), ("b", "k3", at(-9), at(9999), 1)], "customer_id string, customer_key string, effective_from timestamp_ntz, effective_to timestamp_ntz, version_number int")
    full = [r for r in marts.customer_activity(txn, customers=dim).collect() if r["is_active_90d"]]
    expected: dict[int, list[int]] = {}
    for r in full:
        e = expected.setdefault(r["date_key"], [0, 0, 0, 0, 0])
        for k, x in enumerate((1, r["active_card_count_90d"], r["transaction_count_90d"], r["customer_key"] != "-1", r["customer_key"] == "k2")):
            e[k] += x
    got = {int(r["day"].strftime("%Y%m%d")): [r[c] for c in ("active", "cards", "n", "keyed", "second")] for r in marts.activity_totals(txn, dim, parts=3).collect()}
    assert got == expected and len(got) > 200
    each = {(i, x): [t for t in rows if t[0] == i and d(x - 89) <= t[2] <= d(x)] for i in "abc" for x in range(301)}
    naive = {int(d(x).strftime("%Y%m%d")): [sum(map(bool, ts)), sum(len({t[1] for t in s if t[1] not in (None, "-1")}) for s in ts), sum(map(len, ts))] for x in range(301) if any(ts := [each[i, x] for i in "abc"])}
    assert {k: v[:3] for k, v in got.items()} == naive


def test_narrow_lines_keep_the_same_row(spark, tmp_path):
    """Copies of a line that differ late in the order: a narrow read sees the row that all columns choose."""
    day = dt.datetime(2024, 1, 1)
    lines = [(o, p, s, 1, q, e, 0.1, 0.2, f, "O", day) for o in range(40) for p, s, q, e, f in ((o % 3, 5, 1.0, 9.0, "A"), (o % 2, 7, 1.0, 9.0, "R"), (o % 2, 7, 2.0, 3.0, "N"), (2, 7, 2.0, 3.0, "R"))]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = retail.unique_lines(spark, str(tmp_path))
    for columns in (["l_shipdate"], ["l_partkey"], ["l_suppkey"], ["l_extendedprice", "l_returnflag"]):
        some = retail.unique_lines(spark, str(tmp_path), columns=columns).select("l_orderkey", "l_linenumber", *columns)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))


def test_daily_trend_counts_distinct_without_copies_of_rows(spark):
    r = random.Random(7)
    pick = lambda *xs: r.choice(xs)
    rows = [(pick(1, 2), pick("x", None), pick("m", "n"), Decimal(pick(-3, 0, 5)), pick(True, False), pick("-1", None, "c1", "c2", "c3"), pick("-1", None, "u1", "u2")) for _ in range(200)]
    txn = spark.createDataFrame(rows, "date_key int, mcc string, merchant_id string, amount decimal(18,2), is_error boolean, card_id string, customer_id string")
    out = marts.daily_trend(txn, parts=3)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    real = lambda t, k: len({x[k] for x in t} - {None, "-1"})
    for x in out.collect():
        t = [y for y in rows if y[:3] == (x["date_key"], x["mcc"], x["merchant_id"])]
        assert (x["transaction_count"], x["unique_cards"], x["unique_customers"], x["failed_transaction_count"]) == (len(t), real(t, 5), real(t, 6), sum(y[4] for y in t))
        assert (x["total_spend_amount"], x["total_inflow_amount"]) == (sum(-y[3] for y in t if y[3] < 0), sum(y[3] for y in t if y[3] > 0))


def test_nearest_place_meets_few_of_crowded_places(spark):
    """A city of places, several at one position, and points far from it: the side shrinks, the result stays that of all pairs."""
    r = random.Random(5)
    at = [(round(48 + r.random(), 3), round(2 + r.random(), 3)) for _ in range(150)]
    places = [(500 - k, *at[k % 150]) for k in range(400)] + [(1000, -40.0, 170.0), (1001, None, 3.0)]
    points = [(k, round(47.5 + 2 * r.random(), 3), round(1.5 + 2 * r.random(), 3)) for k in range(60)] + [(60, -89.0, 10.0), (61, 10.0, -179.9), (62, None, 1.0)]
    known = spark.createDataFrame(places, "place long, plat double, plon double")
    got = {x["id"]: x["place"] for x in marts.nearest_place(spark.createDataFrame(points, "id long, lat double, lon double"), known, 5.0).collect()}
    pairs = spark.createDataFrame(points, "id long, lat double, lon double").crossJoin(known).where("lat IS NOT NULL AND plat IS NOT NULL").withColumn("km", marts.haversine_km())
    best = {x["id"]: x["b"]["place"] for x in pairs.groupBy("id").agg(F.min(F.struct("km", "place")).alias("b")).collect()}
    assert got == best | {62: None}
    assert marts._side(known.dropna(), 5.0) < 0.01 < 0.08 < marts._side(known.where("place >= 1000").dropna(), 5.0)


def test_interval_audit_passes_once(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    first, end = dt.datetime(1900, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59)
    rows = [
        ("fine", first, t(2000), False), ("fine", t(2000), end, True), ("gap", first, t(2000), False), ("gap", t(2001), end, True), ("over", first, t(2002), False), ("over", t(2001), end, True),
        ("late", t(1950), end, True), ("short", first, t(2000), True), ("none", first, end, False), ("two", first, t(2000), True), ("two", t(2000), end, True),
    ]
    out = scd2.interval_violations(spark.createDataFrame(rows, "k string, effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean"), "k")
    assert sorted(map(tuple, out.collect())) == [("gap", "gap"), ("late", "uncovered"), ("none", "current versions"), ("over", "overlap"), ("short", "uncovered"), ("two", "current versions")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_primary_category_of_an_array(spark):
    arrays = [[("b", 2), ("a", 1), ("a", 1), ("c", 1)], [("-1", 3), ("x", 1)], [(None, 2), ("x", 1), (None, 1)], [("z", 1)]]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, counts array<struct<mcc: string, n: bigint>>")
    got = df.select("k", marts.primary_category(F.col("counts")).alias("t")).orderBy("k").collect()
    assert [(x["t"]["primary_mcc"], x["t"]["distinct_mcc_count"]) for x in got] == [("a", 3), ("-1", 1), (None, 1), ("z", 1)]


def test_merchant_days_are_not_shuffled_after_they_are_written_out(spark):
    """Categories are looked at where a window changes: after days are written out, rows only meet the base, which is broadcast."""
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("m", "b", d(0)), ("m", "a", d(10)), ("m", "b", d(10)), ("m", "c", d(39)), ("n", "-1", d(5)), ("n", "z", d(70))]
    txn = spark.createDataFrame([(*x, Decimal(-2), False) for x in rows], "merchant_id string, mcc string, day date, amount decimal(18,2), is_error boolean")
    out = marts.merchant_error(txn, 1, 0.5, parts=2)
    got = {(x["date_key"], x["merchant_id"]): (x["primary_mcc"], x["distinct_mcc_count"], x["transaction_count_30d"]) for x in out.collect()}
    expected = {}
    for x in range(71):
        for m in "mn":
            inside = [r[1] for r in rows if r[0] == m and d(x - 29) <= r[2] <= d(x)]
            if inside:
                expected[int(d(x).strftime("%Y%m%d")), m] = (min(inside, key=lambda c: (-inside.count(c), c)), len(set(inside) - {"-1"}), len(inside))
    assert got == expected
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def _new_files(spark, name, run):
    """Data files that a run leaves in the shared folder under a name."""
    at = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).glob(f"{name}-*/*.parquet"))
    before = at()
    run()
    return at() - before


def test_merchant_sums_come_in_as_many_tasks_as_parts(spark):
    """Tasks that sum by day follow the parts that the rows call for, not the shuffle's default, which grows with the input."""
    rows = [(f"m{k % 9}", f"c{k % 4}", dt.date(2024, 1, 1) + dt.timedelta(days=k % 50), Decimal(-2), k % 5 == 0) for k in range(900)]
    txn = spark.createDataFrame(rows, "merchant_id string, mcc string, day date, amount decimal(18,2), is_error boolean")
    assert len(_new_files(spark, "merchant-daily", lambda: marts.merchant_error(txn, 1, 0.5, parts=7))) == 7


def test_merchant_windows_are_those_of_the_report(spark):
    r = random.Random(3)
    rows = [(r.choice(["m", "n", "o", None]), r.choice(["a", "-1", None]), dt.date(2024, 1, 1) + dt.timedelta(days=r.choice((r.randrange(40), r.randrange(400)))), Decimal(-2), False) for _ in range(150)]
    txn = spark.createDataFrame(rows, "merchant_id string, mcc string, day date, amount decimal(18,2), is_error boolean")
    for floor in (1, 3):
        windows, first = marts.merchant_windows(txn, floor, parts=3)
        got = [(int(x["day"].strftime("%Y%m%d")), x["merchant_id"], x["window_day_count"]) for x in windows.collect()]
        report = marts.merchant_error(txn, floor, 0.5, parts=2).select("date_key", "merchant_id", "window_day_count").collect()
        assert sorted(got, key=str) == sorted(map(tuple, report), key=str) and len(got) > 100 and first == min(x[2] for x in rows)


def test_incomplete_merchant_windows_read_merchants_and_days_once(spark, tmp_path):
    """No table of parts, and what is written has three columns. A line without an order does not begin the history; copies of a line count once."""
    at = lambda *x: dt.datetime(2024, *x)
    lines = [(o, 1, 7, 1, day) for o, day in enumerate([at(1, 1)] * 5 + [at(1, 10)] * 5 + [at(2, 25)] * 5 + [at(3, 5)])] + [(20, n, 8, n, at(2, 25)) for n in (1, 2, 3, 4)] + [(20, 1, 8, 1, at(2, 25)), (99, 1, 7, 1, dt.datetime(2023, 11, 1))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k) for k in range(21)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = []
    files = _new_files(spark, "merchant-*", lambda: got.extend(map(tuple, queries.QUERIES["merchant_windows_incomplete"](spark, str(tmp_path)).collect())))
    assert sorted(got) == [(20240201, "7", 29), (20240301, "7", 29)]
    assert spark.read.parquet(*map(str, files)).columns == ["merchant_id", "day", "n"]


def test_merchant_counts_come_in_as_many_tasks_as_parts(spark):
    """Dealt out once, to the parts that the rows call for; a merchant of several years is in several."""
    rows = [(f"m{k % 60}", dt.date(2020 + k % 7, 1, 1) + dt.timedelta(days=k % 50)) for k in range(900)] + [("large", dt.date(2020 + k % 7, 5, 1 + k % 9)) for k in range(900)]
    txn = spark.createDataFrame(rows, "merchant_id string, day date")
    files = _new_files(spark, "merchant-counts", lambda: marts.merchant_windows(txn, 1, parts=7))
    at = spark.read.parquet(*map(str, files)).select("merchant_id", "day", F.input_file_name().alias("file"))
    of = at.groupBy("merchant_id", F.year("day").alias("year")).agg(F.countDistinct("file").alias("files")).collect()
    assert len(files) == 7 and {x["files"] for x in of} == {1} and at.where("merchant_id = 'large'").select("file").distinct().count() > 1
