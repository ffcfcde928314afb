"""What grows with the input: minutes formed, passes over the input, keys shuffled to find hot ones."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netpen.adapters import view
from netpen.functions import ring
from netpen.operators import hot, ranges
from netpen.plans.audit import chain_breaks
from netpen.plans.lifecycle import replay_rules
from netpen.plans.register import _meets_stored, register
from netpen.plans.rulecalc import placed_observations
from netpen.session import stage
from netpen.sources.obs_files import drop_blank, number_data_lines
from tests.helpers import at, table
from tests.test_operators import rules


def counted(df, column):
    """The table, and a counter of the rows that have been worked out."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def tick(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(tick, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_rule_overlaps_against_pairs(spark):
    pick = random.Random(5)
    specs = [(f"R{pick.randrange(6)}", pick.randrange(1440), 1 + pick.randrange(1440)) for _ in range(60)]
    specs += [("R1", 0, 1440), ("R9", 700, 700), ("R1", 5, 6), ("R2", 5, 6), ("R3", 5, 6)] + specs[:3]
    covers = [{(s + i) % 1440 for i in range(e - s if e > s else e - s + 1440)} for _, s, e in specs]
    want = {}
    for i, (code, _, _) in enumerate(specs):
        met = [(s, c, j) for j, (c, s, _) in enumerate(specs) if c != code and covers[i] & covers[j]]
        if met:
            want[i] = min(met)[1:]
    got = ranges.rule_overlaps(rules(spark, *specs)).collect()
    assert {r.rule_id: (r.other_rule_code, r.other_rule_id) for r in got} == want and len(got) == len(want)


def test_rules_of_one_start_form_each_minute_once():
    """However many rules begin together, their minutes come at most twice."""
    pick = random.Random(6)
    cells = pd.DataFrame([(30, 30, n, f"R{pick.randrange(50):02}", i) for i, n in enumerate(
        pick.randrange(1, 1441) for _ in range(3000))], columns=["start_minute", "__at", "__minutes", "rule_code", "rule_id"])
    spans = ranges._reaching(cells)
    assert spans["minutes"].sum() <= 2 * ring.DAY_MINUTES


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_events_of_rules_are_read_once(spark, hot_rows):
    stored = table(spark, "ts_rule", *[dict(rule_id=i, rule_code=f"R{i % 2}", status=["DRAFT", "ENABLED"][i % 4 == 3]) for i in range(6)])
    events = spark.createDataFrame(
        [(i, i * 5 % 7, at("2024-01-01") + dt.timedelta(hours=i * 7 % 40), ["ENABLE", "RETIRE", "PAUSE"][i % 11 % 3])
         for i in range(40)], "event_id long, rule_id long, event_time timestamp_ntz, action string")
    events, seen = counted(events, "action")
    assert replay_rules(stored, events, hot_rows).count() == 40
    assert seen.value == 40


def stored_tables(spark):
    return {"feeding_record": table(spark, "feeding_record", dict(record_no="N3")),
            "feeding_plan": table(spark, "feeding_plan", dict(plan_id=1, batch_id=1, status="ACTIVE", cage_no="C9")),
            "fish_batch": table(spark, "fish_batch", dict(batch_id=1, cage_no="C1"), dict(batch_id=2, cage_no="C2"))}


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_new_records_are_read_once(spark, hot_rows):
    rows = spark.createDataFrame(
        [(i, f"N{i % 6}", 1 + i % 3, None, "P" if i % 7 else "", 1.0, at("2024-01-01")) for i in range(30)],
        "request_id long, record_no string, batch_id long, plan_id long, feed_type string, amount_kg double, feeding_time timestamp_ntz")
    rows, seen = counted(rows, "record_no")
    done = register("feeding_record", rows, stored_tables(spark), hot_rows)
    want, held = {}, set()
    for i in range(30):
        if i % 7 == 0:
            want[i] = "required:feed_type"
        elif 1 + i % 3 == 3:
            want[i] = "batch_missing"
        elif i % 6 == 3 or i % 6 in held:
            want[i] = "key_exists"
        else:
            held.add(i % 6)
    assert {r.request_id: r.reason for r in done.rejected.collect()} == want
    assert sorted(r.request_id for r in done.accepted.collect()) == sorted(set(range(30)) - set(want))
    assert seen.value == 30


def test_lines_are_read_once(spark):
    lines = spark.createDataFrame([("f", i, "x" if i % 3 else " ") for i in range(50)], "checksum string, line_no long, raw_line string")
    lines, seen = counted(lines, "raw_line")
    got = sorted((r.line_no, r.data_idx) for r in number_data_lines(lines, 5).collect())
    assert got == [(n, i) for i, n in enumerate(n for n in range(50) if n % 3)]
    assert seen.value == 50


def test_looks_for_hot_keys_shuffle_buckets(spark, monkeypatch):
    monkeypatch.setattr(hot, "MIN_BUCKETS", 8)
    monkeypatch.setattr(hot, "BUCKETS_PER_PARTITION", 1)
    df = spark.range(400).select(F.when(F.col("id") < 90, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("j"))
    found = hot.hot_keys_of(df, 60, one=["k"], two=["j"], both=["k", "j"])
    hashes = lambda *c: {r[0] for r in df.where(" and ".join(f"{n} = {v}" for n, v in c)).select(F.xxhash64(*[n for n, _ in c])).collect()}
    assert set(found["one"]) == hashes(("k", 7)) and len(found["one"]) == 1
    assert set(found["two"]) == hashes(("j", 0)) | hashes(("j", 1)) and not found["both"]


def test_checks_of_a_chain_share_one_scan(spark):
    """No event is multiplied before it is known to be broken."""
    events = table(spark, "migration_event", *[
        dict(migration_no=f"M{i}", chain_no="A", seq_no=i + 1 + (i > 3), source_cage_no="C", target_cage_no="C",
             occurred_at=f"2024-01-{i + 1:02}", snapshot_json="{}") for i in range(6)])
    chains = table(spark, "migration_chain", dict(chain_no="A"))
    found = chain_breaks(chains, events)
    got = {(r.check_name, r.seq_no): r.run_length for r in found.collect()}
    assert got[("SEQ_CONTINUOUS", 6)] == 1 and got[("HANDOFF_EQUAL", 1)] == 6 and got[("HANDOFF_EQUAL", 2)] is None
    assert len(got) == 13
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # scanned before, on events


def test_segments_are_not_multiplied_by_batches(spark):
    tides = table(spark, "tide_session", *[
        dict(tide_id=i, tide_no=f"T{i}", cage_no="C", business_date="2024-01-01", start_at_utc=f"2024-01-01 {6 * i:02}:00",
             end_at_utc=f"2024-01-01 {6 * i + 5:02}:00") for i in range(4)])
    wanted = spark.createDataFrame([(b, dt.date(2024, 1, 1), "C", "UTC") for b in range(20)],
                                   "batch_id long, business_date date, cage_no string, time_zone string")
    points = spark.createDataFrame([(i, f"O{i}", i % 25, at(f"2024-01-01 {i % 24:02}:30"), 1.0) for i in range(100)],
                                   "obs_id long, obs_no string, batch_id long, observed_at_utc timestamp_ntz, feed_amount_kg double")
    placed = placed_observations(wanted, tides, points)
    inside = [i for i in range(100) if i % 25 < 20 and i % 24 != 23]
    assert sorted((r.obs_id, r.batch_id, r.tide_id) for r in placed.collect()) == [
        (i, i % 25, i % 24 // 6 if i % 24 % 6 != 5 else None) for i in inside]
    assert "explode" not in placed._jdf.queryExecution().optimizedPlan().toString()  # hours are met before batches


def test_lines_that_are_expressions_are_formed_once(spark):
    """No filter goes below the line and forms it a second time."""
    seen = spark.sparkContext.accumulator(0)

    def form(value):
        seen.add(1)
        return value

    lines = spark.createDataFrame([("f", i, "x" if i % 3 else " ") for i in range(50)], "checksum string, line_no long, raw_line string")
    kept = drop_blank(lines.withColumn("raw_line", F.udf(form, "string")("raw_line")))
    assert kept.columns == lines.columns
    assert sorted(r.line_no for r in kept.collect()) == [n for n in range(50) if n % 3]
    assert seen.value == 50


@pytest.mark.parametrize("name", ["stored_observation", "stored_record", "stored_report"])
def test_stored_views_take_events_that_were_worked_out(spark, tmp_path, name):
    events = spark.createDataFrame([(i, at("2024-01-05") + dt.timedelta(seconds=i % 4), i % 3, "a", i * 1.5, "{}") for i in range(40)],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.unionByName(events.where("event_id < 9")).write.parquet(f"{tmp_path}/events.parquet")
    picked = stage(view(spark, str(tmp_path), "stored_event"), "picked")
    plain, given = view(spark, str(tmp_path), name), view(spark, str(tmp_path), name, {"stored_event": picked})
    assert plain.schema == given.schema and sorted(map(str, plain.collect())) == sorted(map(str, given.collect()))
    assert "Window" not in given._jdf.queryExecution().optimizedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("given_")]


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_stored_tides_are_met_in_one_scan(spark, hot_rows, monkeypatch):
    scans = []
    carry = hot.OrderedScan.carry
    monkeypatch.setattr(hot.OrderedScan, "carry", lambda self, *a, **k: scans.append(1) or carry(self, *a, **k))
    pick = random.Random(8)
    minute = lambda n: at("2024-01-01") + dt.timedelta(minutes=n)
    old = [(f"C{pick.randrange(3)}", s := pick.randrange(300), s + pick.choice([0, 1, 5, 40, -3])) for _ in range(25)]
    new = [(i, f"C{pick.randrange(4)}", s := pick.randrange(300), s + 1 + pick.randrange(12)) for i in range(200)]
    stored = spark.createDataFrame([(c, minute(s), minute(e)) for c, s, e in old],
                                   "cage_no string, start_at_utc timestamp_ntz, end_at_utc timestamp_ntz")
    asked = spark.createDataFrame([(i, c, minute(s), minute(e)) for i, c, s, e in new],
                                  "request_id long, cage_no string, start_at_utc timestamp_ntz, end_at_utc timestamp_ntz")
    met = lambda c, s, e: any(c == k and (a < e and b > s or s <= a < e) for k, a, b in old)
    want = [i for i, c, s, e in new if met(c, s, e)]
    assert 20 < len(want) < 180
    assert sorted(r.request_id for r in _meets_stored(asked, stored, hot_rows).collect()) == want
    assert len(scans) == 1
