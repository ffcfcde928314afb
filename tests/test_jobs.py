"""Rule calculation, migration, audit, overview, posting, registration, lifecycle, guards."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from netpen.plans import audit, deletable, lifecycle, migration, overview, posting, register
from netpen.plans.rulecalc import recalculate
from netpen.sources.sinks import append_events, replace_results
from netpen.sources.snapshots import decode_rules
from netpen.sources.tables import empty
from tests.helpers import at, dicts, table

FOUR_RULES = [("PEAK-DAY", "PEAK", 360, 600, "1.5"), ("FLAT-DAY", "FLAT", 600, 1080, "1.0"),
              ("VALLEY-EVE", "VALLEY", 1080, 1320, "0.8"), ("PEAK-NIGHT", "PEAK", 1320, 120, "1.2")]


def rules(spark, *specs, status="ENABLED"):
    return table(spark, "ts_rule", *[
        dict(rule_id=i, rule_code=c, version_no=1, rule_type=t, start_minute=s, end_minute=e, coefficient=k, status=status)
        for i, (c, t, s, e, k) in enumerate(specs)])


def calc(spark, zone, rule_specs, spans, amounts, hot_rows=None):
    """One batch in one cage; spans are (start, end, business date), amounts (time, kg)."""
    tides = table(spark, "tide_session", *[
        dict(tide_id=i, tide_no=f"T{i}", cage_no="C", start_at_utc=s, end_at_utc=e, business_date=d)
        for i, (s, e, d) in enumerate(spans)])
    observations = table(spark, "feed_observation", *[
        dict(obs_id=i, obs_no=f"O{i}", batch_id=1, observed_at_utc=t, feed_amount_kg=k) for i, (t, k) in enumerate(amounts)])
    days = spark.createDataFrame([(1, dt.date.fromisoformat(d)) for d in sorted({s[2] for s in spans})] + [(7, dt.date(2026, 9, 13))],
                                 "batch_id long, business_date date")
    return recalculate(
        days, table(spark, "fish_batch", dict(batch_id=1, cage_no="C", status="BREEDING")),
        table(spark, "cage_sea_area", dict(cage_no="C", sea_area="S", time_zone=zone)),
        tides, observations, rules(spark, *rule_specs), hot_rows)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_cross_midnight(spark, hot_rows):
    got = calc(spark, "Asia/Shanghai", FOUR_RULES,
               [("2026-09-13 14:00", "2026-09-13 18:00", "2026-09-13"), ("2026-09-13 18:00", "2026-09-13 22:00", "2026-09-14")],
               [("2026-09-13 14:00", "10.004"), ("2026-09-13 16:30", "20.000"), ("2026-09-13 17:59:59", "5.000"),
                ("2026-09-13 18:00", "7.000"), ("2026-09-13 19:00", "3.000")], hot_rows)
    first, second = got.results.orderBy("business_date").collect()
    assert (first.obs_total, first.obs_matched, first.obs_unmatched) == (3, 3, 0)
    assert (str(first.peak_total_kg), str(first.total_weighted_kg), str(first.flat_total_kg)) == ("42.00", "42.00", "0.00")
    assert (second.obs_total, second.obs_matched, second.obs_unmatched, str(second.total_weighted_kg)) == (2, 0, 2, "0.00")
    details = got.details.orderBy("obs_id").collect()
    assert [d.obs_local_time for d in details] == ["22:00:00", "00:30:00", "01:59:59"]
    assert [d.weighted_kg.normalize() for d in details] == [Decimal("12.0048"), Decimal("24").normalize(), Decimal("6")]
    assert [(r.batch_id, r.reason) for r in got.rejected.collect()] == [(7, "batch_missing")]
    snapshot = got.results.limit(1).select(decode_rules(F.col("rule_snapshot")).alias("s")).first().s
    assert [r.ruleCode for r in snapshot] == ["PEAK-DAY", "FLAT-DAY", "VALLEY-EVE", "PEAK-NIGHT"]


@pytest.mark.parametrize("coefficient, amounts, total", [
    ("1.0", ["0.004"] * 3, "0.01"), ("1.5", ["3.335"] * 2, "10.01"), ("1.0", [f"{n}.000" for n in range(1, 11)], "55.00"),
    ("2.0", ["10.000"], "20.00")])
def test_one_rounding(spark, coefficient, amounts, total):
    start = at("2026-09-13 01:00")
    got = calc(spark, "UTC", [("ALL", "FLAT", 0, 1440, coefficient)], [("2026-09-13 00:00", "2026-09-13 12:00", "2026-09-13")],
               [((start + dt.timedelta(minutes=i)).isoformat(), kg) for i, kg in enumerate(amounts)])
    assert str(got.results.first().total_weighted_kg) == total and got.details.count() == len(amounts)


def test_gap_counts_and_day_without_tide_keeps_a_row(spark):
    got = calc(spark, "UTC", [("ALL", "FLAT", 0, 720, "1")],
               [("2026-09-13 00:00", "2026-09-13 01:00", "2026-09-13"), ("2026-09-13 02:00", "2026-09-13 03:00", "2026-09-13")],
               [("2026-09-13 00:30", "1"), ("2026-09-13 01:30", "1"), ("2026-09-13 03:00", "1")])
    row = got.results.first()
    assert (row.obs_total, row.obs_matched, row.obs_unmatched) == (2, 1, 1)
    nothing = calc(spark, "UTC", [], [("2026-09-13 00:00", "2026-09-13 01:00", "2026-09-13")], [])
    assert {r.reason for r in nothing.rejected.collect()} == {"no_enabled_rule", "batch_missing"}


def migration_tables(spark):
    return dict(
        batches=table(spark, "fish_batch", dict(batch_id=1, batch_no="FB-1", cage_no="A", fingerling_count=10_000, status="MONITORING", version=0)),
        plans=table(spark, "feeding_plan", dict(plan_id=1, plan_no="P", batch_id=1, cage_no="A", daily_amount_kg="5", status="ACTIVE", version=0)),
        sensors=table(spark, "sensor", dict(sensor_id=1, sensor_no="S-ON", cage_no="A", status="ONLINE", version=0),
                      dict(sensor_id=2, sensor_no="S-OFF", cage_no="A", status="OFFLINE", version=0)),
        readings=table(spark, "sensor_reading", dict(reading_id=1, sensor_id=1, metric_value="6.80", reading_time="2026-01-01 00:00"),
                       dict(reading_id=2, sensor_id=1, metric_value="7.10", reading_time="2026-01-01 08:00"),
                       dict(reading_id=3, sensor_id=2, metric_value="5.50", reading_time="2025-12-01 00:00")),
        records=table(spark, "feeding_record", dict(record_id=1, batch_id=1, amount_kg="100.00", posted=1),
                      dict(record_id=2, batch_id=1, amount_kg="20.00", posted=0)),
        reports=table(spark, "survival_report", dict(report_id=1, batch_id=1, alive_count=9500, survival_rate="0.9500", report_time="2026-01-01")),
        chains=empty(spark, "migration_chain"), events=empty(spark, "migration_event"))


REQUEST = ("request_id long, migration_no string, batch_id long, target_cage_no string, transfer_type string, occurred_at timestamp_ntz, "
           "operator_id long, operator_name string, expected_batch_version int, expected_chain_seq int, remark string")


def ask(spark, *rows):
    return spark.createDataFrame(
        [(i, no, b, cage, kind, at(when), 7, "li", None, None, None) for i, (no, b, cage, kind, when) in enumerate(rows)], REQUEST)


def test_two_hops_and_audit(spark):
    t = migration_tables(spark)
    first = migration.migration_handoff(ask(spark, ("M-1", 1, "B", "replace", "2026-02-01")), now="2026-03-01", **t)
    (event,) = first.events.collect()
    assert (event.seq_no, event.source_cage_no, event.target_cage_no, event.transfer_type) == (1, "A", "B", "REPLACE")
    assert (event.fish_estimate_count, str(event.cumulative_feed_kg), str(event.latest_survival_rate)) == (9500, "100.00", "0.9500")
    assert (event.feeding_plan_count, event.feeding_record_count, event.sensor_count) == (1, 2, 1)
    got = {s.sensor_no: (str(s.latest_value), s.moved) for s in first.sensors.collect()}
    assert got == {"S-ON": ("7.1000", 1), "S-OFF": ("5.5000", 0)}
    assert [(r.batch_id, r.cage_no, r.version) for r in first.moved_batches.collect()] == [(1, "B", 1)]
    assert [r.sensor_id for r in first.moved_sensors.collect()] == [1]
    assert all(r.passed for r in audit.audit_chains(first.chains, first.events).collect())

    t["batches"] = table(spark, "fish_batch", dict(batch_id=1, batch_no="FB-1", cage_no="B", fingerling_count=10_000, status="MONITORING", version=1))
    t["records"] = t["records"].unionByName(table(spark, "feeding_record", dict(record_id=3, batch_id=1, amount_kg="50", posted=1)))
    t["chains"], t["events"] = first.chains, first.events
    second = migration.migration_handoff(ask(spark, ("M-2", 1, "C", None, "2026-02-10")), now="2026-03-01", **t)
    (event,) = second.events.collect()
    assert (event.seq_no, str(event.cumulative_feed_kg), event.transfer_type) == (2, "150.00", "TRANSFER")
    both = append_events(first.events, second.events).unionByName(first.events)
    for hot_rows in (None, 1):
        checks = audit.audit_chains(second.chains, both, hot_rows).collect()
        assert len(checks) == 6 and all(c.passed for c in checks)
    assert append_events(both, second.events).count() == 0
    broken = both.withColumn("snapshot_json", F.when(F.col("seq_no") == 2, "{broken").otherwise(F.col("snapshot_json")))
    failed = {c.check_name for c in audit.audit_chains(second.chains, broken).collect() if not c.passed}
    assert failed == {"HANDOFF_EQUAL", "SNAPSHOT_READABLE"}
    assert [r.migration_no for r in audit.handoff_mismatches(broken).collect()] == ["M-2"]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_refused_requests(spark, hot_rows):
    t = migration_tables(spark)
    t["batches"] = table(spark, "fish_batch", *[
        dict(batch_id=i, batch_no=f"FB-{i}", cage_no=c, fingerling_count=10, status=s, version=0)
        for i, c, s in ((1, "A", "MONITORING"), (2, "X", "BREEDING"), (3, "D", "CLOSED"), (4, "E", "BREEDING"), (5, "E", "BREEDING"))])
    requests = ask(spark, ("M-1", 1, "B", "", "2026-02-01"), ("M-2", 1, "F", "", "2026-02-01"), ("M-3", 2, "B", "", "2026-02-01"),
                   ("M-4", 3, "G", "", "2026-02-01"), ("M-5", 4, "A", "", "2026-02-01"), ("M-6", 9, "G", "", "2026-02-01"),
                   ("M-7", 4, "E", "", "2026-02-01"), ("M-8", 4, "H", "SWAP", "2026-02-01"), ("M-9", 4, "H", "", "2027-01-01"),
                   ("M 10", 4, "H", "", "2026-02-01"), ("M-11", 4, "H", "", "2026-02-01"), ("M-12", 5, "I", "", "2026-02-01"),
                   ("M-1", 5, "J", "", "2026-02-01"))
    got = migration.migration_handoff(requests, now="2026-03-01", hot_rows=hot_rows, one_task=hot_rows or 10_000, **t)
    assert {r.request_id: r.reason for r in got.rejected.collect()} == {
        3: "batch_terminal", 5: "batch_missing", 6: "target_occupied", 7: "bad_transfer_type", 8: "in_the_future",
        9: "bad_migration_no", 12: "migration_no_exists"}
    # Cages that were left are filled again: A by batch 4, B by batch 2.
    assert {(r.batch_id, r.cage_no, r.version) for r in got.moved_batches.collect()} == {
        (1, "F", 2), (2, "B", 1), (4, "H", 2), (5, "I", 1)}
    assert {(r.batch_id, r.origin_cage_no, r.current_cage_no, r.current_seq) for r in got.chains.collect()} == {
        (1, "A", "F", 2), (2, "X", "B", 1), (4, "E", "H", 2), (5, "E", "I", 1)}
    # The ONLINE sensor of A goes along to B and F; the other one stays in A, where batch 4 finds it later.
    assert {(r.migration_no, r.sensor_id, r.moved, r.version) for r in got.sensors.collect()} == {
        ("M-1", 1, 1, 0), ("M-1", 2, 0, 0), ("M-2", 1, 1, 1), ("M-11", 2, 0, 0)}
    assert {(r.sensor_id, r.cage_no, r.version) for r in got.moved_sensors.collect()} == {(1, "F", 2)}
    assert {(r.migration_no, r.plan_id, r.version) for r in got.plans.collect()} == {("M-1", 1, 0), ("M-2", 1, 1)}
    # All moves bear one date here.
    assert {r.check_name for r in audit.audit_chains(got.chains, got.events).collect() if not r.passed} == {"TIME_ORDERED"}


def moves_one_by_one(batches, asked):
    """Every request on the state that the ones before it left."""
    at = {b: c for b, c, _ in batches}
    active = {b for b, _, s in batches if s in ("BREEDING", "MONITORING")}
    hops, numbers, out = dict.fromkeys(at, 0), set(), {}
    for request, number, batch, target, version, seq in sorted(asked):
        reason = None
        if batch not in at:
            reason = "batch_missing"
        elif batch not in active:
            reason = "batch_terminal"
        elif target == at[batch]:
            reason = "same_cage"
        elif any(at[b] == target for b in active):
            reason = "target_occupied"
        elif number in numbers:
            reason = "migration_no_exists"
        elif version is not None and version != hops[batch]:
            reason = "batch_version_differs"
        elif seq is not None and seq != hops[batch]:
            reason = "chain_seq_differs"
        else:
            at[batch], hops[batch] = target, hops[batch] + 1
            numbers.add(number)
        out[request] = reason
    return out, at


@pytest.mark.parametrize("seed, hot_rows, one_task", [(1, None, 0), (2, 3, 5), (3, None, 10_000)])
def test_random_moves_equal_a_loop(spark, seed, hot_rows, one_task):
    """Dense cages; a third of the batches are asked to move at least three times."""
    pick = random.Random(seed)
    cages = [f"C{i}" for i in range(14)]
    batches = [(b, pick.choice(cages[:9]), pick.choice(["BREEDING", "MONITORING", "BREEDING", "CLOSED"])) for b in range(9)]
    asked = []
    for i in pick.sample(range(500), 60):
        few = pick.choice([batches[:3], batches])
        asked.append((i, f"M-{pick.choice([i, pick.randrange(12)])}", pick.choice([b[0] for b in few] + [99]), pick.choice(cages),
                      pick.choice([None, None, None, pick.randrange(3)]), pick.choice([None, None, None, pick.randrange(3)])))
    t = migration_tables(spark)
    t["batches"] = table(spark, "fish_batch", *[
        dict(batch_id=b, batch_no=f"FB-{b}", cage_no=c, fingerling_count=10, status=s, version=0) for b, c, s in batches])
    requests = spark.createDataFrame([(i, no, b, c, "", at("2026-02-01"), 7, "li", v, q, None) for i, no, b, c, v, q in asked], REQUEST)
    judged = {r.request_id: r for r in migration.judge_requests(
        requests, t["batches"], t["chains"], t["events"], "2026-03-01", hot_rows, one_task).collect()}
    want, places = moves_one_by_one(batches, asked)
    assert {i: r.reason for i, r in judged.items()} == want and list(want.values()).count(None) > 8
    last = {}
    for i in sorted(i for i, reason in want.items() if reason is None):
        last[judged[i].batch_id] = judged[i].target_cage_no
    assert all(places[b] == c for b, c in last.items())


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_timeline(spark, hot_rows):
    events = table(spark, "migration_event", *[
        dict(migration_no=f"M{n}", chain_no="K", batch_id=1, seq_no=n, source_cage_no=s, target_cage_no=g, occurred_at=w)
        for n, s, g, w in ((1, "A", "B", "2026-02-01"), (2, "B", "C", "2026-03-01"))])
    facts = table(spark, "feeding_record", *[
        dict(record_id=i, batch_id=b, feeding_time=w) for i, (b, w) in enumerate(
            ((1, "2026-01-01"), (1, "2026-02-01"), (1, "2026-02-15"), (1, "2026-04-01"), (2, "2026-01-01")))])
    batches = table(spark, "fish_batch", dict(batch_id=1, cage_no="C"), dict(batch_id=2, cage_no="Z"))
    got = audit.place_on_timeline(facts, "feeding_time", "record_id", batches, events, hot_rows=hot_rows)
    assert [(r.segment_cage_no, r.segment_migration_no) for r in got.orderBy("record_id").collect()] == [
        ("A", None), ("B", "M1"), ("B", "M1"), ("C", "M2"), ("Z", None)]


def test_overview_follows_the_batch(spark):
    batches = [dict(batch_id=1, cage_no="C", status="HARVESTED"), dict(batch_id=2, cage_no="C", status="MONITORING")]
    records = table(spark, "feeding_record", *[
        dict(record_id=i, batch_id=b, amount_kg=k, posted=p) for i, (b, k, p) in enumerate(((1, "100", 1), (2, "40", 0), (2, "60", 1)))])
    total = lambda rows: overview.cage_feed_total(table(spark, "fish_batch", *rows), records).first().posted_feed_kg
    assert str(total(batches)) == "160.00"
    batches[0]["status"] = "CLOSED"
    assert str(total(batches)) == "60.00"


def test_posting_is_idempotent(spark):
    records = table(spark, "feeding_record", dict(record_id=1, posted=0), dict(record_id=2, posted=1, posted_time="2026-01-01"))
    once = posting.post_pending(records, "2026-02-01")
    assert once.posted_count.first().posted_count == 1
    twice = posting.post_pending(once.records, "2026-03-01")
    assert twice.posted_count.first().posted_count == 0
    assert dicts(twice.records, "record_id") == dicts(once.records, "record_id")
    after, refused = posting.post_selected(records, spark.createDataFrame([(1,), (2,), (3,)], "record_id long"), "2026-02-01")
    assert {r.record_id: r.reason for r in refused.collect()} == {2: "already_posted", 3: "record_missing"}
    assert all(r.posted == 1 for r in after.collect())


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_register_kinds(spark, hot_rows):
    t = {n: empty(spark, n) for n in ("feeding_record", "survival_report", "harvest_batch", "feeding_plan", "sensor_reading",
                                      "feed_observation", "tide_session", "ts_rule")}
    t["fish_batch"] = table(spark, "fish_batch", dict(batch_id=1, batch_no="B1", cage_no="C", fingerling_count=10_000, status="BREEDING", migration_no="M9"),
                            dict(batch_id=2, batch_no="B2", cage_no="D", fingerling_count=5, status="CLOSED"))
    t["sensor"] = table(spark, "sensor", dict(sensor_id=1, sensor_no="S1", cage_no="C", status="OFFLINE"))
    t["cage_sea_area"] = table(spark, "cage_sea_area", dict(cage_no="C", sea_area="S", time_zone="Asia/Shanghai"))
    pick = lambda kind, columns, *rows: register.register(
        kind, table(spark, kind, *rows).coalesce(1).select(*columns).withColumn("request_id", F.monotonically_increasing_id()), t, hot_rows)
    reasons = lambda result: [r.reason for r in result.rejected.orderBy("request_id").collect()]

    got = pick("fish_batch", ["batch_no", "cage_no", "species", "fingerling_count", "average_weight_g", "stocking_time"],
               dict(batch_no="B9", cage_no="C", species="cod", fingerling_count=5, stocking_time="2026-01-01"),
               dict(batch_no="B1", cage_no="C", species="cod", fingerling_count=5, stocking_time="2026-01-01"),
               dict(batch_no="B8", cage_no=" ", species="cod", fingerling_count=0, stocking_time="2026-01-01"),
               dict(batch_no="B9", cage_no="C", species="cod", fingerling_count=5, stocking_time="2026-01-01"))
    assert [r.status for r in got.accepted.collect()] == ["BREEDING"]
    assert reasons(got) == ["key_exists", "required:cage_no", "key_exists"]

    got = pick("feeding_plan", ["plan_no", "batch_id", "feed_type", "daily_amount_kg", "feed_frequency", "start_date", "end_date"],
               dict(plan_no="P1", batch_id=1, feed_type="x", daily_amount_kg="1", feed_frequency=2, start_date="2026-01-02", end_date="2026-01-01"),
               dict(plan_no="P2", batch_id=1, feed_type="x", daily_amount_kg="1", feed_frequency=2, start_date="2026-01-01", end_date="2026-01-01"))
    assert reasons(got) == ["end_before_start"] and got.accepted.first().cage_no == "C"

    got = pick("survival_report", ["report_no", "batch_id", "alive_count", "survival_rate", "report_time"],
               dict(report_no="R1", batch_id=1, alive_count=9500, report_time="2026-01-01"),
               dict(report_no="R2", batch_id=1, alive_count=10_001, report_time="2026-01-01"))
    assert str(got.accepted.first().survival_rate) == "0.9500" and reasons(got) == ["more_than_stocked"]

    got = pick("harvest_batch", ["harvest_no", "batch_id", "harvest_count", "total_weight_kg", "harvest_time"],
               dict(harvest_no="H1", batch_id=2, harvest_count=1, total_weight_kg="1", harvest_time="2026-01-01"),
               dict(harvest_no="H2", batch_id=1, harvest_count=1, total_weight_kg="1", harvest_time="2026-01-01"))
    assert reasons(got) == ["batch_closed"] and got.accepted.first().status == "PENDING"

    got = pick("feeding_record", ["record_no", "batch_id", "plan_id", "feed_type", "amount_kg", "feeding_time"],
               dict(record_no="F1", batch_id=1, feed_type="x", amount_kg="1", feeding_time="2026-01-01"),
               dict(record_no="F2", batch_id=1, plan_id=4, feed_type="x", amount_kg="1", feeding_time="2026-01-01"))
    row = got.accepted.first()
    assert (row.cage_no, row.posted, row.migration_no) == ("C", 0, "M9") and reasons(got) == ["plan_missing"]

    got = pick("sensor_reading", ["reading_no", "sensor_id", "metric_value", "reading_time"],
               dict(reading_no="X", sensor_id=1, metric_value="1", reading_time="2026-01-01"))
    assert reasons(got) == ["sensor_not_online"]
    got = pick("sensor", ["sensor_no", "cage_no", "sensor_type", "metric_unit", "depth_m", "install_time"],
               dict(sensor_no="S2", cage_no="C", sensor_type="t", metric_unit="C", install_time="2026-01-01"))
    assert got.accepted.first().status == "ONLINE"
    got = pick("feed_observation", ["obs_no", "batch_id", "observed_at_utc", "feed_amount_kg"],
               dict(obs_no="O", batch_id=1, observed_at_utc="2026-01-01", feed_amount_kg="1"))
    assert got.accepted.first().cage_no == "C"
    got = pick("cage_sea_area", ["cage_no", "sea_area", "time_zone"], dict(cage_no="E", sea_area="S", time_zone="Mars/Base"),
               dict(cage_no="C", sea_area="S", time_zone="UTC"), dict(cage_no="G", sea_area="S", time_zone="UTC"))
    assert reasons(got) == ["bad_time_zone", "key_exists"] and got.accepted.count() == 1
    got = pick("tide_session", ["tide_no", "cage_no", "start_at_utc", "end_at_utc"],
               dict(tide_no="T1", cage_no="C", start_at_utc="2026-09-13 16:30", end_at_utc="2026-09-13 20:00"),
               dict(tide_no="T2", cage_no="C", start_at_utc="2026-09-13 19:59", end_at_utc="2026-09-13 21:00"),
               dict(tide_no="T3", cage_no="Q", start_at_utc="2026-09-13 19:59", end_at_utc="2026-09-13 21:00"))
    assert reasons(got) == ["overlaps_tide", "no_sea_area"] and str(got.accepted.first().business_date) == "2026-09-14"


def test_lifecycles(spark):
    batches = table(spark, "fish_batch", dict(batch_id=1, status="BREEDING"), dict(batch_id=2, status="HARVESTED"))
    moves = [(1, 1, "MONITORING"), (2, 1, "BREEDING"), (3, 1, "HARVESTED"), (4, 1, "MONITORING"), (5, 1, "HARVESTED"),
             (6, 1, "CLOSED"), (7, 1, "HARVESTED"), (8, 2, "HARVESTED"), (9, 2, "BREEDING"), (10, 3, "CLOSED"), (11, 2, "LOST")]
    events = spark.createDataFrame([(e, b, at("2026-01-01") + dt.timedelta(days=e), s) for e, b, s in moves],
                                   "event_id long, batch_id long, event_time timestamp_ntz, target_status string")
    for hot_rows in (None, 2):
        replay = lifecycle.replay_status("fish_batch", batches, events, hot_rows)
        assert {r.event_id for r in replay.events.collect() if not r.accepted} == {4, 7, 9, 10, 11}
        assert {r.batch_id: r.status for r in replay.final.collect() if r.batch_id < 3} == {1: "CLOSED", 2: "HARVESTED"}
    plans = table(spark, "feeding_plan", dict(plan_id=1, status="ACTIVE"))
    steps = spark.createDataFrame([(i, 1, at("2026-01-01") + dt.timedelta(days=i), s) for i, s in enumerate(["SUSPENDED", "ACTIVE", "FINISHED", "ACTIVE"])],
                                  "event_id long, plan_id long, event_time timestamp_ntz, target_status string")
    assert [r.accepted for r in lifecycle.replay_status("feeding_plan", plans, steps).events.orderBy("event_id").collect()] == [1, 1, 1, 0]


def test_random_lifecycle_equals_a_loop(spark):
    rng = random.Random(2)
    names = ["BREEDING", "MONITORING", "HARVESTED", "CLOSED"]
    allowed = {"BREEDING": set(names), "MONITORING": set(names), "HARVESTED": {"HARVESTED", "CLOSED"}, "CLOSED": {"CLOSED"}}
    events = [(i, 1 if rng.random() < .6 else rng.randrange(2, 9), at("2026-01-01") + dt.timedelta(hours=i),
               rng.choices(names, [8, 8, 1, 1])[0]) for i in range(200)]
    state, expected = {b: "BREEDING" for b in range(1, 9)}, []
    for _, b, _, s in events:
        ok = s in allowed[state[b]]
        expected.append(int(ok))
        state[b] = s if ok else state[b]
    df = spark.createDataFrame(events, "event_id long, batch_id long, event_time timestamp_ntz, target_status string")
    batches = table(spark, "fish_batch", *[dict(batch_id=b, status="BREEDING") for b in range(1, 9)])
    replay = lifecycle.replay_status("fish_batch", batches, df, hot_rows=20)
    assert [r.accepted for r in replay.events.orderBy("event_id").collect()] == expected
    assert {r.batch_id: r.status for r in replay.final.collect()} == state


def test_guards_and_replacement(spark):
    t = {"ts_rule": rules(spark, *FOUR_RULES[:1], status="DRAFT").unionByName(rules(spark, *FOUR_RULES[1:2])),
         "harvest_batch": table(spark, "harvest_batch", dict(harvest_id=1, status="ACCEPTED"))}
    assert sorted(r.deletable for r in deletable.deletable("ts_rule", t).collect()) == [0, 1]
    assert deletable.deletable("harvest_batch", t).first().reason == "accepted"
    day = lambda d: dt.date(2026, 1, d)
    old = spark.createDataFrame([(1, day(1), 5), (1, day(2), 6), (2, day(1), 7)], "batch_id long, business_date date, v int")
    new = spark.createDataFrame([(1, day(1), 9)], "batch_id long, business_date date, v int")
    assert sorted(r.v for r in replace_results(old, new).collect()) == [6, 7, 9]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_rule_moves(spark, hot_rows):
    versions = rules(spark, ("A", "PEAK", 0, 60, "1"), ("A", "PEAK", 0, 90, "1"), ("B", "FLAT", 60, 120, "1"), status="DRAFT")
    steps = [(0, "RETIRE"), (0, "ENABLE"), (0, "ENABLE"), (1, "ENABLE"), (0, "RETIRE"), (1, "RETIRE"), (1, "RETIRE"), (2, "ENABLE"), (9, "ENABLE"), (2, "STOP")]
    events = spark.createDataFrame([(i, r, at("2026-01-01") + dt.timedelta(days=i), a) for i, (r, a) in enumerate(steps)],
                                   "event_id long, rule_id long, event_time timestamp_ntz, action string")
    got = lifecycle.replay_rules(versions, events, hot_rows).orderBy("event_id").collect()
    assert [r.reason for r in got] == ["not_enabled", None, "not_draft", None, "not_enabled", None, "not_enabled", None, "rule_missing", "bad_action"]

    drafts = register.register("ts_rule", spark.createDataFrame(
        [(1, "A", "PEAK", 0, 60, Decimal(1)), (2, "A", "NIGHT", 0, 60, Decimal(1)), (3, "A", "PEAK", 5, 5, Decimal(1)), (4, "A", "FLAT", 1, 2, Decimal(1)),
         (5, "Z", "FLAT", 1, 2, Decimal(1))], "request_id long, rule_code string, rule_type string, start_minute int, end_minute int, coefficient decimal(12,4)"),
        {"ts_rule": versions}, hot_rows)
    assert [(r.request_id, r.version_no, r.status) for r in drafts.accepted.orderBy("request_id").collect()] == [(1, 2, "DRAFT"), (4, 3, "DRAFT"), (5, 1, "DRAFT")]
    assert sorted(r.reason for r in drafts.rejected.collect()) == ["bad_interval", "bad_rule_type"]


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_enabling_rules(spark, hot_rows):
    stored = table(spark, "ts_rule", *[
        dict(rule_id=i, rule_code=c, version_no=v, start_minute=s, end_minute=e, status=st)
        for i, (c, v, s, e, st) in enumerate((("A", 1, 0, 60, "ENABLED"), ("A", 2, 0, 90, "DRAFT"), ("B", 1, 30, 40, "DRAFT"),
                                              ("C", 1, 80, 100, "DRAFT"), ("D", 1, 200, 300, "DRAFT"), ("E", 1, 1400, 10, "RETIRED")))])
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (9, 6), (1, 7)], "rule_id long, request_id long")
    got = lifecycle.enable_rules(stored, wanted, "2026-01-01", hot_rows)
    assert {r.request_id: r.reason for r in got.rejected.collect()} == {
        2: "overlaps_enabled_rule", 3: "overlaps_enabled_rule", 5: "not_draft", 6: "rule_missing", 7: "not_draft"}
    assert {r.rule_id: r.status for r in got.rules.collect()} == {0: "RETIRED", 1: "ENABLED", 2: "DRAFT", 3: "DRAFT", 4: "ENABLED", 5: "RETIRED"}


def enable_one_by_one(rules, wanted):
    """Statuses and reasons, one request after the other."""
    minutes = {i: {m % 1440 for m in range(s, e if e > s else e + 1440)} for i, _, s, e, _ in rules}
    code, status, out = {r[0]: r[1] for r in rules}, {r[0]: r[4] for r in rules}, {}
    for rule, request in sorted(wanted, key=lambda w: w[1]):
        live = [i for i in status if status[i] == "ENABLED"]
        if rule not in status:
            out[request] = "rule_missing"
        elif status[rule] != "DRAFT":
            out[request] = "not_draft"
        elif any(code[i] != code[rule] and minutes[i] & minutes[rule] for i in live):
            out[request] = "overlaps_enabled_rule"
        else:
            status.update({i: "RETIRED" for i in live if code[i] == code[rule]})
            status[rule], out[request] = "ENABLED", None
    return status, out


@pytest.mark.parametrize("seed, stretch", [(1, 200_000), (2, 25), (3, 7)])
def test_random_enabling_equals_a_loop(spark, seed, stretch):
    """In one stretch and in many; refused drafts block nobody and may be asked for again."""
    pick = random.Random(seed)
    rules = []
    for i in range(60):
        start = pick.randrange(1440)
        rules.append((i, f"R{pick.randrange(15)}", start, 1 + (start + pick.randrange(1, 90)) % 1440,
                      pick.choice(["DRAFT"] * 6 + ["RETIRED"])))
    held = set()
    for n, r in enumerate(rules):  # some are enabled at first, of different codes apart
        if n % 9 == 0 and r[1] not in held and not any(
                o[4] == "ENABLED" and {m % 1440 for m in range(r[2], r[3] if r[3] > r[2] else r[3] + 1440)}
                & {m % 1440 for m in range(o[2], o[3] if o[3] > o[2] else o[3] + 1440)} for o in rules):
            rules[n] = (*r[:4], "ENABLED")
            held.add(r[1])
    wanted = [(pick.choice([*range(60), 99]), q) for q in pick.sample(range(1000), 120)]
    stored = table(spark, "ts_rule", *[
        dict(rule_id=i, rule_code=c, version_no=1, start_minute=s, end_minute=e, status=st) for i, c, s, e, st in rules])
    got = lifecycle.enable_rules(stored, spark.createDataFrame(wanted, "rule_id long, request_id long"), "2026-01-01",
                                 stretch_rows=stretch)
    status, reasons = enable_one_by_one(rules, wanted)
    assert {r.rule_id: r.status for r in got.rules.collect()} == status
    assert {r.request_id: r.reason for r in got.rejected.collect()} == {q: r for q, r in reasons.items() if r}
    assert sum(r is None for r in reasons.values()) > 10


def test_handoff_documents_count_their_items(spark):
    t = migration_tables(spark)
    got = migration.migration_handoff(ask(spark, ("M-1", 1, "B", "replace", "2026-02-01")), now="2026-03-01", **t)
    document = got.events.first().snapshot_json
    assert "movedSensors" not in document and got.sensors.count() == 2
    assert all(r.passed for r in audit.audit_chains(got.chains, got.events).collect())
    # A side that counts other sensors fails the check, and the event is named.
    counted = got.events.first().sensor_count
    wrong = got.events.withColumn("snapshot_json", F.regexp_replace(
        "snapshot_json", f'"movedSensorCount":{counted}(?=.*"target")', f'"movedSensorCount":{counted + 12_000}'))
    failed = {r.check_name for r in audit.audit_chains(got.chains, wrong).collect() if not r.passed}
    assert failed == {"HANDOFF_EQUAL"}
    assert [r.migration_no for r in audit.handoff_mismatches(wrong).collect()] == ["M-1"]
