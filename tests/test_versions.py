"""Published tables: whole or not at all, no shuffle by key, reads that follow the days asked for."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from netpen.plans.importer import stored_state
from netpen.schemas import FEED_OBSERVATION, TABLES
from netpen.sources.versions import Overtaken, Version, change, drop_unread, open_version, publish
from netpen.streaming.ingest import observations_of, store_observations
from tests.helpers import table

SCHEMA = "k long, v int, day date"
D1, D2, D3 = (dt.date(2026, 9, d) for d in (1, 2, 3))


def state(spark, path):
    return sorted((r.k, r.v, r.day) for r in open_version(spark, path).collect())


def put(spark, path, days, *rows):
    change(spark, path, ["k"], lambda version: (spark.createDataFrame(rows, SCHEMA), days))


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [], (1, 10, D1), (2, 20, D2))
    opened = open_version(spark, path)
    broken = spark.createDataFrame([(1, 11, D1), (2, 21, D2)], SCHEMA).withColumn(
        "v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        change(spark, path, ["k"], lambda version: (broken, [D1, D2]))
    assert state(spark, path) == [(1, 10, D1), (2, 20, D2)]
    put(spark, path, [D1, D2], (1, 11, D1), (3, 30, D3))
    assert state(spark, path) == [(1, 11, D1), (3, 30, D3)]
    assert sorted(r.v for r in opened.collect()) == [10, 20]
    drop_unread(spark, path, keep=1)
    assert state(spark, path) == [(1, 11, D1), (3, 30, D3)]
    put(spark, path, [D1, D3])
    assert state(spark, path) == [] and Version(spark, path).number == 3


def test_an_overtaken_writer_computes_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [], (1, 10, D1))
    seen = []

    def build(version):
        rows = open_version(spark, path, version=version).withColumn("v", F.col("v") + 1).select("k", "v", "day")
        if not seen:
            put(spark, path, [D1], (1, 50, D1))
        seen.append(version.number)
        return rows, [D1]

    change(spark, path, ["k"], build)
    assert seen == [1, 2] and state(spark, path) == [(1, 51, D1)]
    old = Version(spark, path)
    put(spark, path, [D2], (2, 20, D2))
    with pytest.raises(Overtaken):
        publish(spark, path, spark.createDataFrame([(9, 9, D3)], SCHEMA), ["k"], [D3], old)
    assert state(spark, path) == [(1, 51, D1), (2, 20, D2)]


def shuffled(plan, name):
    """Scans of ``name`` that have an exchange between them and their first join."""
    path, found = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+\-*()\d]*", line).group())
        path = [(d, text) for d, text in path if d < depth] + [(depth, line)]
        if "FileScan" in line and name in line:
            above = []
            for _, text in reversed(path[:-1]):
                if "Join" in text:
                    break
                above.append(text)
            found.append(any("Exchange" in text for text in above))
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_not_shuffled_by_an_import(spark, tmp_path):
    time = dt.datetime(2026, 9, 1, 8)
    stored = {}
    for name, keys, row in (
            ("cage_observation", ["voyage_no", "cage_no", "observed_at"],
             dict(voyage_no="V", cage_no="A", observed_at=time, record_no="FR-1", report_no="SR-1")),
            ("feeding_record", ["record_no"], dict(record_no="FR-1", batch_id=1, feeding_time=time, posted=0)),
            ("survival_report", ["report_no"], dict(report_no="SR-1", batch_id=1, report_time=time))):
        path = str(tmp_path / name)
        rows = table(spark, name, row).withColumn("day", F.lit(D1))
        other = rows.withColumn("day", F.lit(D3))
        change(spark, path, keys, lambda version, rows=rows.unionByName(other): (rows, []))
        stored[name] = open_version(spark, path, TABLES[name])
    incoming = table(spark, "cage_observation", dict(voyage_no="V", cage_no="A", observed_at=time))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stored_state(stored["cage_observation"], incoming, stored["feeding_record"].where(F.col("day") == D1),
                           stored["survival_report"].where(F.col("day") == D1), table(spark, "fish_batch", dict(batch_id=1)))
        plan = plan_of(got)
        assert shuffled(plan, "netpen_") == [False, False, False]
        assert re.search(r"PartitionFilters: \[[^\]]*2026-09-01", plan)
        assert [(r.record_batch_id, r.report_batch_id) for r in got.collect()] == [(1, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_late_observations_read_only_their_days(spark, tmp_path):
    path = str(tmp_path / "feed_observation")
    batches = table(spark, "fish_batch", *[dict(batch_id=i, cage_no=f"C{i}") for i in (1, 2, 3)])
    tides = table(spark, "tide_session", *[
        dict(tide_id=i, cage_no=f"C{b}", business_date="2026-09-02", start_at_utc="2026-09-02 20:00",
             end_at_utc="2026-09-03 02:00") for i, b in enumerate((1, 2, 3))])
    pairs = spark.createDataFrame([(2, D2)], "batch_id long, business_date date")
    arrive = lambda *rows: store_observations(spark, path, table(spark, "feed_observation", *[
        dict(obs_id=i, obs_no=f"O{i}", batch_id=b, observed_at_utc=t, feed_amount_kg="1") for i, b, t in rows]))
    read = lambda: observations_of(spark, path, pairs, batches, tides)
    assert read().count() == 0
    arrive((1, 2, "2026-09-02 21:00"), (2, 2, "2026-09-03 01:00"), (3, 1, "2026-09-03 01:00"), (4, 2, "2026-09-04 01:00"),
           (5, 2, None))
    assert sorted(r.obs_id for r in read().collect()) == [1, 2]
    before = set(read().inputFiles())
    # History grows; a stored number comes again; one more row lies in the days.
    arrive(*[(10 + d, 2, f"2026-08-{d:02} 01:00") for d in range(1, 9)])
    assert set(read().inputFiles()) == before
    arrive((1, 2, "2026-09-01 01:00"), (6, 2, "2026-09-03 00:30"))
    assert sorted(r.obs_id for r in read().collect()) == [1, 2, 6]
    plan = plan_of(read())
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan) and "GreaterThanOrEqual(batch_id,2)" in plan
    assert open_version(spark, path, FEED_OBSERVATION).count() == 14
