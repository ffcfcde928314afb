"""Arriving files and late observations, with real folders."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from netpen.schemas import FEED_OBSERVATION
from netpen.sources.sinks import replace_table, upsert_table
from netpen.sources.versions import open_version
from netpen.sources.obs_files import EMPTY_CHECKSUM
from netpen.streaming.ingest import (
    WATERMARKS, import_folder, stream_imports, stream_recalculation, with_expectations)
from tests.helpers import table
from tests.test_importer import HEADER, batch, sensor, write

NOW = dt.datetime(2026, 12, 1)


def test_files_are_imported_once_and_corrections_upsert(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "tables")
    inbox.mkdir()
    reference = {"fish_batch": table(spark, "fish_batch", batch(1, "A")),
                 "sensor": table(spark, "sensor", sensor(1, "S-1", "A")), "harvest_batch": table(spark, "harvest_batch")}
    go = lambda: stream_imports(spark, str(inbox), root, str(tmp_path / "cp"), lambda: reference, lambda: NOW).awaitTermination()
    row = "V,A,2026-09-1{},{},,,,"
    write(inbox, "one.csv", "\n".join([HEADER, row.format("0T08:00:00", "10.00"), row.format("1T08:00:00", "11.00")]))
    go()
    write(inbox, "two.csv", "\n".join([HEADER, row.format("1T08:00:00", "12.00"), row.format("2T08:00:00", "13.00"), row.format("0 08:00", "10")]))
    write(inbox, "copy.csv", "\n".join([HEADER, row.format("0T08:00:00", "10.00"), row.format("1T08:00:00", "11.00")]))
    go()
    go()
    read = lambda name: open_version(spark, f"{root}/{name}")
    amounts = sorted(str(r.feed_amount_kg) for r in read("cage_observation").collect())
    assert amounts == ["10.00", "12.00", "13.00"]
    assert sorted(str(r.amount_kg) for r in read("feeding_record").collect()) == amounts
    assert {r.batch_id for r in read("feeding_record").collect()} == {1}
    ledger = lambda name: spark.read.parquet(f"{root}/{name}")
    assert sorted(r.outcome for r in ledger("import_row").collect()) == ["SKIPPED", "SUCCESS", "SUCCESS", "SUCCESS", "UPDATED"]
    assert ledger("import_file").count() == 2
    assert len({r.file_path for r in ledger("import_file").collect()}) == 2


def test_a_stream_refuses_files_that_differ_from_their_expectation(spark, tmp_path):
    inbox, told, root = tmp_path / "in", str(tmp_path / "told"), str(tmp_path / "tables")
    inbox.mkdir()
    reference = {"fish_batch": table(spark, "fish_batch", batch(1, "A")),
                 "sensor": table(spark, "sensor", sensor(1, "S-1", "A")), "harvest_batch": table(spark, "harvest_batch")}
    sums, names = {}, {}
    for i, name in enumerate(("right.csv", "wrong.csv", "silent.csv")):
        write(inbox, name, f"{HEADER}\nV-{i},A,2026-09-10T08:00:00,{i + 1}.00,,,,\n")
        sums[name] = hashlib.sha256((inbox / name).read_bytes()).hexdigest()
        names[name] = f"file://{inbox / name}"
    (inbox / "empty.csv").touch()
    tell = lambda *rows: spark.createDataFrame(rows, "file_path string, expected_checksum string").write.mode("append").parquet(told)
    tell((names["right.csv"], f" {sums['right.csv'].upper()} "), (names["wrong.csv"], sums["right.csv"]))

    def go():
        expected = spark.readStream.schema("file_path string, expected_checksum string").parquet(told)
        stream_imports(spark, str(inbox), root, str(tmp_path / "cp"), lambda: reference, lambda: NOW,
                       expected=expected).awaitTermination()
        return sorted((r.file_path.split("/")[-1], r.status, r.error_message) for r in spark.read.parquet(f"{root}/import_file").collect())

    first = [("empty.csv", "FAILED", "bad_header"), ("right.csv", "SUCCESS", None), ("wrong.csv", "FAILED", "checksum_mismatch")]
    assert go() == first
    tell((names["silent.csv"], ""), (names["wrong.csv"], sums["wrong.csv"]), (names["right.csv"], "0"))
    assert go() == [first[0], first[1], ("silent.csv", "SUCCESS", None), ("wrong.csv", "SUCCESS", None)]
    assert sorted(r.voyage_no for r in open_version(spark, f"{root}/cage_observation").collect()) == ["V-0", "V-1", "V-2"]
    assert EMPTY_CHECKSUM in {r.checksum for r in spark.read.parquet(f"{root}/import_file").collect()}


def test_expectations_meet_files_within_the_time_limit(spark, tmp_path):
    files, told, out = (str(tmp_path / n) for n in ("files", "told", "out"))
    schemas = {files: "file_path string, seen_at timestamp", told: "file_path string, expected_checksum string, seen_at timestamp"}
    time = lambda minutes: dt.datetime(2026, 9, 10, 8, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)
    put = lambda at, *rows: spark.createDataFrame([(*r[:-1], time(r[-1])) for r in rows], schemas[at]).coalesce(
        1).write.mode("append").parquet(at)

    def go():
        joined = with_expectations(spark.readStream.schema(schemas[files]).parquet(files),
                                   spark.readStream.schema(schemas[told]).parquet(told), "60 minutes")
        policy = spark.conf.get(WATERMARKS)
        spark.conf.set(WATERMARKS, "max")
        (joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
        spark.conf.set(WATERMARKS, policy)
        return sorted((r.file_path, r.expected_checksum) for r in spark.read.parquet(out).collect())

    put(files, ("a", 0), ("b", 0), ("c", 0))
    put(told, ("a", "sum-a", 0), ("early", "sum-e", 0))
    assert go() == [("a", "sum-a")]
    put(files, ("early", 30))
    put(told, ("b", "sum-b", 30))
    second = [("a", "sum-a"), ("b", "sum-b"), ("early", "sum-e")]
    assert go() == second
    # Only files arrive from here on; "c" has waited long enough, its expectation comes too late.
    put(files, ("d", 200))
    third = sorted([*second, ("c", "(none)")])
    assert go() == third
    put(told, ("c", "sum-c", 201), ("d", "sum-d", 201))
    assert go() == sorted([*third, ("d", "sum-d")])


def test_two_streams_share_one_root(spark, tmp_path):
    root = str(tmp_path / "tables")
    reference = {"fish_batch": table(spark, "fish_batch", batch(1, "A")),
                 "sensor": table(spark, "sensor", sensor(1, "S-1", "A")), "harvest_batch": table(spark, "harvest_batch")}
    for name, amount in (("first", "1.50"), ("second", "2.50")):
        (tmp_path / name).mkdir()
        write(tmp_path / name, "f.csv", f"{HEADER}\nV-{name},A,2026-09-10T08:00:00,{amount},,,,\n")
        stream_imports(spark, str(tmp_path / name), root, str(tmp_path / f"cp-{name}"), lambda: reference,
                       lambda: NOW).awaitTermination()
    amounts = sorted(str(r.feed_amount_kg) for r in open_version(spark, f"{root}/cage_observation").collect())
    assert amounts == ["1.50", "2.50"] and spark.read.parquet(f"{root}/import_file").count() == 2


def test_a_run_is_repeatable_and_its_name_is_taken(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "tables")
    inbox.mkdir()
    reference = {"fish_batch": table(spark, "fish_batch", batch(1, "A")),
                 "sensor": table(spark, "sensor"), "harvest_batch": table(spark, "harvest_batch")}
    write(inbox, "f.csv", f"{HEADER}\nV,A,2026-09-10T08:00:00,1.50,,,,\n")
    import_folder(spark, str(inbox), root, reference, NOW, "run-1")
    # A posting run comes between the decision and its repeated application.
    path = f"{root}/feeding_record"
    posted = open_version(spark, path).select("record_no", "feeding_time", F.lit(1).alias("posted"))
    upsert_table(spark, path, "feeding_record", posted, ["record_no"], "feeding_time")
    before = sorted(map(str, spark.read.parquet(f"{root}/import_row").collect()))
    import_folder(spark, str(inbox), root, reference, NOW, "run-1")
    assert [r.posted for r in open_version(spark, path).collect()] == [1]
    assert sorted(map(str, spark.read.parquet(f"{root}/import_row").collect())) == before
    write(inbox, "g.csv", f"{HEADER}\nV,A,2026-09-11T08:00:00,1.50,,,,\n")
    with pytest.raises(ValueError, match="other files"):
        import_folder(spark, str(inbox), root, reference, NOW, "run-1")


def test_an_emptied_day_keeps_no_rows(spark, tmp_path):
    path = str(tmp_path / "result")
    schema = "batch_id long, business_date date, kg int"
    keys = ["batch_id"]
    rows = [(1, dt.date(2026, 9, 11), 5), (1, dt.date(2026, 9, 12), 6), (2, dt.date(2026, 9, 12), 7)]
    pairs = lambda *p: spark.createDataFrame(p, "batch_id long, business_date date")
    replace_table(spark, path, spark.createDataFrame(rows, schema), pairs(*[r[:2] for r in rows]), keys)
    replace_table(spark, path, spark.createDataFrame([], schema), pairs(rows[0][:2], rows[1][:2]), keys)
    assert [(r.batch_id, r.kg) for r in open_version(spark, path).collect()] == [(2, 7)]
    replace_table(spark, path, spark.createDataFrame([(1, rows[0][1], 9)], schema), pairs(rows[0][:2]), keys)
    assert sorted((r.batch_id, r.kg) for r in open_version(spark, path).collect()) == [(1, 9), (2, 7)]


def test_late_observations_recalculate_their_days(spark, tmp_path):
    source, root = str(tmp_path / "obs"), str(tmp_path / "tables")
    reference = {
        "fish_batch": table(spark, "fish_batch", dict(batch_id=1, cage_no="C")),
        "cage_sea_area": table(spark, "cage_sea_area", dict(cage_no="C", sea_area="S", time_zone="UTC")),
        "tide_session": table(spark, "tide_session", *[
            dict(tide_id=d, tide_no=f"T{d}", cage_no="C", business_date=f"2026-09-1{d}",
                 start_at_utc=f"2026-09-1{d} 00:00", end_at_utc=f"2026-09-1{d} 12:00") for d in (1, 2)]),
        "ts_rule": table(spark, "ts_rule", dict(rule_id=1, rule_code="ALL", version_no=1, rule_type="FLAT", start_minute=0,
                                                end_minute=1440, coefficient="2", status="ENABLED"))}

    def arrive(*rows):
        table(spark, "feed_observation", *[
            dict(obs_id=i, obs_no=f"O{i}", batch_id=1, observed_at_utc=t, feed_amount_kg=k) for i, t, k in rows
        ]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FEED_OBSERVATION).parquet(source)
        stream_recalculation(spark, stream, root, str(tmp_path / "cp"), lambda: reference).awaitTermination()
        got = open_version(spark, f"{root}/calc_result").collect()
        return {str(r.business_date): (str(r.total_weighted_kg), r.obs_total) for r in got}

    assert arrive((1, "2026-09-11 03:00", "1"), (2, "2026-09-12 03:00", "2")) == {
        "2026-09-11": ("2.00", 1), "2026-09-12": ("4.00", 1)}
    assert arrive((3, "2026-09-11 04:00", "5"), (1, "2026-09-11 03:00", "1")) == {
        "2026-09-11": ("12.00", 2), "2026-09-12": ("4.00", 1)}
    assert open_version(spark, f"{root}/calc_detail").count() == 3
