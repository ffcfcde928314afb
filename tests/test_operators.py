"""Skew-safe operators: the hot route must give what plain Python gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from netpen.operators.hot import OrderedScan, hot_keys, skew_join
from netpen.operators.latest import first_per_key, latest
from netpen.operators.listing import first_failures, list_table, lookup, outcome_page
from netpen.operators.ranges import day_segments, range_join, rule_overlaps, rules_by_minute, tide_overlaps
from tests.helpers import at, dicts, table


def skewed_rows(n=600, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i,
             rng.choice([None, rng.randrange(100)])) for i in range(n)]


def scanned(spark, hot_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "k string, i long, v int").repartition(4)
    scan = OrderedScan(df, ["k"], ["i"], F.floor(F.col("i") / 50), hot_rows)
    assert bool(scan.hot) == (hot_rows < 100)
    scan.carry(last={"last_v": F.col("v")}, maximum={"max_v": F.col("v")}, count="n")
    scan.carry(last={"last_even": F.when(F.col("n") % 2 == 0, F.struct("i", "v"))})
    return rows, {r.i: r for r in scan.rows().collect()}


def test_ordered_scan_equals_a_loop(spark):
    for hot_rows in (5, 10_000):
        rows, got = scanned(spark, hot_rows)
        state = {}
        for k, i, v in rows:
            last, highest, n, even = state.get(k, (None, None, 0, None))
            r = got[i]
            assert (r.last_v, r.max_v, r.n) == (last, highest, n)
            assert (None if r.last_even is None else tuple(r.last_even)) == even
            state[k] = (last if v is None else v,
                        highest if v is None else max(v, highest if highest is not None else v),
                        n + 1, (i, v) if n % 2 == 0 else even)


def test_ordered_scan_with_null_first_row(spark):
    rows = [("a", None, -1, 5)] + [("a", at("2024-01-01") + dt.timedelta(hours=7 * i), i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, v int")
    scan = OrderedScan(df, ["k"], ["t", "i"], F.to_date("t"), hot_rows=3)
    got = scan.carry(last={"start": F.col("v")}).rows().where("i >= 0").collect()
    assert len(got) == 30 and all(r.start == 5 for r in got)


def test_pieces_are_even_however_rows_lie(spark):
    """A hot key with all rows in one second, and one with most rows in one of many years."""
    one, many = dt.datetime(2024, 1, 1), [dt.datetime(2000 + i % 40 if i % 10 == 0 else 2010, 1, 1) for i in range(2000)]
    rows = [("second", one, i, i * 7 % 2000) for i in range(2000)] + [("years", t, i, i * 7 % 2000) for i, t in enumerate(many)]
    rows += [(f"cold{i % 50}", one, i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i long, v long")
    scan = OrderedScan(df, ["k"], ["t", "i"], hot_rows=500)
    sizes = [r["count"] for r in scan.df.where("__chunk is not null").groupBy("k", "__chunk").count().collect()]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / width
    got = {(r.k, r.i): (r.most, r.n, r.last) for r in scan.carry(
        last={"last": F.when(F.col("v") % 3 == 0, F.col("v"))}, maximum={"most": F.col("v")}, count="n").rows().collect()}
    state = {}
    for k, t, i, v in sorted(rows):
        most, n, last = state.get(k, (None, 0, None))
        assert got[k, i] == (most, n, last)
        state[k] = max(v, most if most is not None else v), n + 1, v if v % 3 == 0 else last


def test_hot_rows_are_spread(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1)], "k string, i long")
    assert len(hot_keys(df, ["k"], 100)) == 1
    dim = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, d int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(df, dim, ["k"], ["i"], "inner", hot_rows=100, salts=16)
        assert joined.count() == 501 and joined.columns == ["k", "i", "d"]
        text = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skew_join_kinds_equal_plain_join(spark):
    rows = [(k if i % 9 else None, i) for k, i, _ in skewed_rows(300)]
    df = spark.createDataFrame(rows, "k string, i long")
    dim = spark.createDataFrame([(k, n) for n, k in enumerate({r[0] for r in rows if r[0]} - {"k1", "k2"})], "k string, d int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew_join(df, dim, ["k"], ["i"], how, hot_rows=3, salts=7)
        assert dicts(salted, "i", "k") == dicts(df.join(dim, "k", how), "i", "k"), how


def test_latest_and_first(spark):
    rows = [("a", at("2024-01-02"), 1, 5), ("a", at("2024-01-02"), 3, None), ("a", at("2024-01-01"), 9, 7), ("b", at("2024-01-01"), 2, 1)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, v int")
    assert [(r.k, r.id, r.v) for r in latest(df, "k", "t", "id", ["v"]).orderBy("k").collect()] == [("a", 3, None), ("b", 2, 1)]
    assert [r.id for r in latest(df, "k", "t", "id", ["v"], lower_id_wins=True).orderBy("k").collect()] == [1, 2]
    flagged = {r.id: r.is_first for r in first_per_key(df, ["k"], ["id"]).collect()}
    assert flagged == {1: True, 3: False, 9: False, 2: True}


def tides(spark, *spans, cage="C"):
    return table(spark, "tide_session", *[
        dict(tide_id=i, tide_no=f"T{i}", cage_no=cage, business_date="2024-01-01",
             start_at_utc=s, end_at_utc=e) for i, (s, e) in enumerate(spans)])


def test_segments_tile_the_envelope(spark):
    spans = [("2024-01-01 00:00", "2024-01-01 05:00"), ("2024-01-01 04:00", "2024-01-01 07:30"),
             ("2024-01-01 01:00", "2024-01-01 02:00"), ("2024-01-01 09:00", "2024-01-01 12:00")]
    for hot_rows in (1, 1000):
        got = day_segments(tides(spark, *spans), hot_rows).orderBy("seg_start").collect()
        assert [(r.seg_start.hour, r.seg_end.hour, r.tide_id) for r in got] == [
            (0, 5, 0), (5, 7, 1), (7, 9, None), (9, 12, 3)]


def test_range_join_equals_brute_force(spark):
    rng = random.Random(5)
    base = at("2024-01-01")
    spans = [(i, f"k{rng.randrange(3)}", base + dt.timedelta(minutes=m), base + dt.timedelta(minutes=m + rng.randrange(0, 300)))
             for i, m in enumerate(rng.randrange(0, 4000) for _ in range(40))]
    points = [(i, f"k{rng.randrange(3)}", base + dt.timedelta(minutes=rng.randrange(0, 4300))) for i in range(300)]
    left = spark.createDataFrame(points, "p long, k string, t timestamp_ntz")
    right = spark.createDataFrame(spans, "s long, k string, a timestamp_ntz, b timestamp_ntz")
    for hot_rows in (2, 10_000):
        got = {(r.p, r.s) for r in range_join(left, right, ["k"], "t", "a", "b", ["p"], hot_rows).collect()}
        assert got == {(p, s) for p, k, t in points for s, k2, a, b in spans if k == k2 and a <= t < b}


def test_tide_overlaps_half_open(spark):
    spans = [("2024-01-01 00:00", "2024-01-01 05:00"), ("2024-01-01 05:00", "2024-01-01 06:00"), ("2024-01-01 05:30", "2024-01-01 07:00")]
    assert [r.tide_id for r in tide_overlaps(tides(spark, *spans), 1).collect()] == [2]


def rules(spark, *specs):
    return table(spark, "ts_rule", *[
        dict(rule_id=i, rule_code=code, version_no=1, rule_type="PEAK", start_minute=s, end_minute=e,
             coefficient="1", status="ENABLED") for i, (code, s, e) in enumerate(specs)])


def test_rules_by_minute_takes_first(spark):
    got = {r.minute: r.rule_code for r in rules_by_minute(rules(spark, ("A", 0, 100), ("B", 50, 200), ("N", 1380, 30))).collect()}
    assert got[0] == "A" and got[99] == "A" and got[100] == "B" and got[1439] == "N" and 200 not in got


def test_rule_overlaps_name_the_first_other(spark):
    found = rule_overlaps(rules(spark, ("A", 0, 100), ("A", 50, 150), ("B", 90, 95), ("C", 300, 310), ("D", 1400, 1)))
    assert {r.rule_id: r.other_rule_code for r in found.collect()} == {0: "B", 1: "B", 2: "A", 4: "A"}


def test_listings(spark):
    batches = table(spark, "fish_batch", *[
        dict(batch_id=i, batch_no=f"B{i}", cage_no=f"C{i % 2}", status="BREEDING", stocking_time=f"2024-01-0{i + 1}") for i in range(4)])
    assert [r.batch_id for r in list_table("fish_batch", batches, cage_no="C1", status="").collect()] == [3, 1]
    readings = table(spark, "sensor_reading", *[
        dict(reading_id=i, sensor_id=1, reading_time=f"2024-01-0{i + 1}") for i in range(5)])
    assert [r.reading_id for r in list_table("sensor_reading", readings, "2024-01-02", "2024-01-04").collect()] == [3, 2, 1]
    found, missing = lookup(batches, spark.createDataFrame([(1,), (9,)], "batch_id long"), "batch_id")
    assert [r.batch_no for r in found.collect()] == ["B1"] and [r.batch_id for r in missing.collect()] == [9]


def test_failures_and_pages(spark):
    ledger = spark.createDataFrame([("f", i, "FAILED" if i % 2 else "SUCCESS") for i in range(2, 40)], "checksum string, line_no long, outcome string")
    assert sorted(r.line_no for r in first_failures(ledger, limit=3).collect()) == [3, 5, 7]
    assert [r.line_no for r in outcome_page(ledger, "f", "failed", 2, 1).collect()] == [5, 7]
    assert outcome_page(ledger, limit=0).count() == 1


def test_pages_at_any_offset(spark):
    rng = random.Random(8)
    rows = [(f"f{rng.randrange(6)}", rng.randrange(60_000), i) for i in range(3000)] + [(f"g{i}", 777, i) for i in range(300)]
    ledger = spark.createDataFrame([(c, n, "FAILED" if i % 3 else "SUCCESS", i) for c, n, i in set(rows)],
                                   "checksum string, line_no long, outcome string, i long").dropDuplicates(["checksum", "line_no"])
    every = sorted((r.line_no, r.checksum, r.outcome) for r in ledger.collect())
    for offset, limit in ((0, 10), (len(every) // 2, 50), (40, 1000), (len(every) - 5, 20), (len(every), 10), (10**9, 1)):
        got = [(r.line_no, r.checksum, r.outcome) for r in outcome_page(ledger, limit=limit, offset=offset).collect()]
        assert got == every[offset:offset + limit]
    failed = [r for r in every if r[2] == "FAILED"]
    got = [(r.line_no, r.checksum, r.outcome) for r in outcome_page(ledger, outcome="failed", limit=30, offset=500).collect()]
    assert got == failed[500:530]
    assert outcome_page(ledger.limit(0)).count() == 0
