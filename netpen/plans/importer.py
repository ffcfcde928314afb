"""Import of observation lines: validate, resolve, replay per key, upsert, keep a row ledger."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netpen.functions import text
from netpen.functions.numbers import alive_count
from netpen.operators.hot import OrderedScan, hot_keys_of, line_chunk, skew_join
from netpen.operators.latest import recency
from netpen.operators.listing import first_failures
from netpen.plans.validate import MAX_RAW_LINE, MAX_RAW_VALUE, error, validate_rows
from netpen.session import stage
from netpen.sources.obs_files import (
    NO_EXPECTATION, data_lines, dedup_files, judge_files, read_obs_files, scan_files, verify_checksum)
from netpen.sources.versions import day_of, days_of

# Fixed values.
SHARD_SIZE = 1000
MAX_REASON = 500
FEED_TYPE = "IMPORT-CSV"
ACTIVE = ("BREEDING", "MONITORING")
TERMINAL = ("HARVESTED", "CLOSED")
REFUSED = ("checksum_missing", "checksum_mismatch")

KEY = ["voyage_no", "cage_no", "observed_at"]
ORDER = ["file_time", "checksum", "line_no"]
MEASURES = ["feed_amount_kg", "survival_rate", "sensor_value", "sensor_unit", "source_device"]


class Import(NamedTuple):
    ledger: DataFrame
    shards: DataFrame
    files: DataFrame
    failures: DataFrame
    observations: DataFrame
    feeding_records: DataFrame
    survival_reports: DataFrame
    sensor_readings: DataFrame


# Reference data ---------------------------------------------------------------------------------

def cage_reference(batches: DataFrame, harvests: DataFrame) -> DataFrame:
    """Per cage: the newest active batch, the newest terminal batch's status, accepted harvest.

    On equal stocking times the lower batch id counts.
    """
    newest = recency(F.col("stocking_time"), F.col("batch_id"), lower_id_wins=True)
    of_batches = batches.select(
        "cage_no", "batch_id", "fingerling_count", "status",
        F.when(F.col("status").isin(*ACTIVE), newest).alias("active_order"),
        F.when(F.col("status").isin(*TERMINAL), newest).alias("terminal_order"),
        F.lit(0).alias("accepted"))
    of_harvests = harvests.where(F.col("status") == "ACCEPTED").select("cage_no", F.lit(1).alias("accepted"))
    return (
        of_batches.unionByName(of_harvests, allowMissingColumns=True).groupBy("cage_no").agg(
            F.max_by("batch_id", "active_order").alias("active_batch_id"),
            F.max_by("fingerling_count", "active_order").alias("active_fingerlings"),
            F.max_by("status", "terminal_order").alias("terminal_status"),
            F.max("accepted").alias("cage_accepted"))
    )


def stored_state(observations: DataFrame, incoming: DataFrame, records: DataFrame,
                 reports: DataFrame, batches: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Stored observations that incoming rows touch, with the state of their linked records.

    Of a published table only the incoming rows' days are read; tables bucketed by their keys are not shuffled.
    """
    if "day" in observations.columns:
        days = days_of(incoming.select(day_of("observed_at").alias("day")))
        observations = observations.where(F.col("day").isin(days)).drop("day")
    touched = observations.join(incoming.select(*KEY).distinct(), KEY, "left_semi")
    linked = (
        touched
        .join(records.select("record_no", F.col("batch_id").alias("record_batch_id"),
                             F.col("posted").alias("record_posted")), "record_no", "left")
        .join(reports.select("report_no", F.col("batch_id").alias("report_batch_id")),
              "report_no", "left")
        .withColumn("linked_batch_id", F.coalesce("record_batch_id", "report_batch_id"))
    )
    status = batches.select(F.col("batch_id").alias("linked_batch_id"), F.col("status").alias("linked_status"))
    stocked = batches.select(F.col("batch_id").alias("report_batch_id"),
                             F.col("fingerling_count").alias("report_fingerlings"))
    linked = stage(linked, "import-stored")
    hot = hot_keys_of(linked, hot_rows, linked=["linked_batch_id"], report=["report_batch_id"])
    linked = skew_join(linked, status, ["linked_batch_id"], KEY, hot=hot["linked"])
    return skew_join(linked, stocked, ["report_batch_id"], KEY, hot=hot["report"])


# Row outcomes -----------------------------------------------------------------------------------

def resolve_rows(sound: DataFrame, cages: DataFrame, sensors: DataFrame,
                 hot: dict[str, list[int]]) -> DataFrame:
    """Attach what a row meets: its cage's batches and its device."""
    row_id = ["checksum", "line_no"]
    devices = sensors.select(
        F.col("sensor_no").alias("source_device"), F.col("sensor_id").alias("device_id"),
        F.col("cage_no").alias("device_cage"), F.col("metric_unit").alias("device_unit"),
        F.col("status").alias("device_status"))
    with_cage = skew_join(sound, cages, ["cage_no"], row_id, hot=hot["cage"])
    return skew_join(with_cage, devices, ["source_device"], row_id, hot=hot["device"])


def _device_error() -> Column:
    device, unit = F.col("source_device"), F.col("sensor_unit")
    return F.when(
        F.col("sensor_value").isNotNull(),
        F.when(F.col("device_id").isNull(), error("source_device", device, "device_missing"))
        .when(F.col("device_cage") != F.col("cage_no"), error("source_device", device, "device_in_other_cage"))
        .when(F.col("device_unit") != unit, error("sensor_unit", unit, "unit_differs"))
        .when(F.col("device_status") != "ONLINE",
              error("source_device", device, F.concat(F.lit("device_"), F.lower("device_status")))))


def replay(rows: DataFrame, stored: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """Outcome of every row, as if the rows of a key were applied one by one in order.

    The stored observation enters as the key's first row, so no join on the business key is needed.

    No step-by-step fold is needed either. Whether a row may be applied depends on its key, the
    stored links and its device, none of which the file can change, and on whether the key exists
    yet, which turns true at the first insertable row and stays true. The values a row meets are
    therefore the last ones supplied by an applicable row before it. An applicable row that supplies
    equal values is SKIPPED and carries the same values on.
    """
    links = ["record_no", "report_no", "reading_no", "record_batch_id", "record_posted",
             "report_batch_id", "report_fingerlings", "linked_status"]
    first = stored.select(*KEY, *MEASURES, *links).withColumn("is_stored", F.lit(True))
    every = rows.withColumn("is_stored", F.lit(False)).unionByName(first, allowMissingColumns=True)

    feed, rate, value = F.col("feed_amount_kg"), F.col("survival_rate"), F.col("sensor_value")
    touches_batch = feed.isNotNull() | rate.isNotNull()
    no_batch = error(
        "cage_no", F.col("cage_no"),
        F.when(F.col("terminal_status").isNotNull(), "batch_terminal").otherwise("no_active_batch"))
    without_batch = F.col("active_batch_id").isNull()
    every = every.withColumn("device_err", _device_error())
    insert_err = F.coalesce("device_err", F.when(touches_batch & without_batch, no_batch))
    insertable = ~F.col("is_stored") & insert_err.isNull()

    scan = OrderedScan(
        every, KEY, ORDER,
        F.struct("file_time", "checksum", line_chunk(F.col("line_no")).alias("block")), hot=hot)
    scan.carry(
        last={"init": F.when(F.col("is_stored"), F.struct(*links))},
        maximum={"inserted": F.when(insertable, 1)})

    init = F.col("init")
    record_is_there = init["record_batch_id"].isNotNull()
    report_is_there = init["report_batch_id"].isNotNull()
    update_err = F.coalesce(
        "device_err",
        F.when(feed.isNotNull() & (init["record_posted"] == 1), error("_row", None, "record_posted")),
        F.when(touches_batch & (F.col("cage_accepted") == 1),
               error("cage_no", F.col("cage_no"), "harvest_accepted")),
        F.when(touches_batch & init["linked_status"].isin(*TERMINAL),
               error("cage_no", F.col("cage_no"), "linked_batch_terminal")),
        F.when(without_batch & ((feed.isNotNull() & ~record_is_there)
                                | (rate.isNotNull() & ~report_is_there)), no_batch))
    exists = init.isNotNull() | F.col("inserted").isNotNull()
    scan.add(row_exists=exists, row_err=F.when(exists, update_err).otherwise(insert_err))
    applicable = F.col("is_stored") | F.col("row_err").isNull()
    sensor = F.struct("sensor_value", "sensor_unit", "source_device")
    scan.carry(last={
        "now_feed": F.when(applicable, feed),
        "now_rate": F.when(applicable, rate),
        "now_sensor": F.when(applicable & value.isNotNull(), sensor)})

    equal = lambda given, met: given.isNull() | F.coalesce(given == met, F.lit(False))
    met = F.col("now_sensor")
    same_sensor = value.isNull() | F.coalesce(
        (value == met["sensor_value"]) & (F.col("sensor_unit") == met["sensor_unit"])
        & (F.col("source_device") == met["source_device"]), F.lit(False))
    same = F.col("row_exists") & equal(feed, F.col("now_feed")) & equal(rate, F.col("now_rate")) & same_sensor
    outcome = (
        F.when(same, "SKIPPED").when(F.col("row_err").isNotNull(), "FAILED")
        .when(F.col("row_exists"), "UPDATED").otherwise("SUCCESS"))
    decided = scan.rows().where(~F.col("is_stored")).withColumn("outcome", outcome)
    return decided.withColumn("err", F.when(F.col("outcome") == "FAILED", F.col("row_err"))).drop(
        "is_stored", "device_err", "inserted", "row_exists", "row_err", "now_feed", "now_rate",
        "now_sensor", *links)


# Outputs ----------------------------------------------------------------------------------------

def row_ledger(invalid: DataFrame, decided: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per data line; failures keep field, raw value, raw line and reason."""
    columns = ["checksum", "file_time", "line_no", "data_idx", "raw_line", "business_key", "outcome", "err"]
    rows = decided.select(*columns).unionByName(
        invalid.withColumn("outcome", F.lit("FAILED")).select(*columns))
    failed = F.col("outcome") == "FAILED"
    return rows.select(
        "checksum", "line_no", F.floor(F.col("data_idx") / shard_size).cast("bigint").alias("shard_index"),
        "business_key", "outcome",
        F.col("err.field").alias("field_name"),
        text.clip(F.col("err.raw"), MAX_RAW_VALUE).alias("raw_value"),
        F.when(failed, text.clip(F.col("raw_line"), MAX_RAW_LINE)).alias("raw_line"),
        text.clip(F.col("err.reason"), MAX_REASON).alias("error_reason"))


def _counts() -> list[Column]:
    of = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return [F.count(F.lit(1)).alias("total_rows"), of("SUCCESS").alias("success_count"),
            of("UPDATED").alias("updated_count"), of("SKIPPED").alias("skipped_count"),
            of("FAILED").alias("failed_count")]


def _status() -> Column:
    return F.when(F.col("failed_count") == 0, "SUCCESS").otherwise("PARTIAL")


def shard_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("checksum", "shard_index").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), *_counts()
    ).withColumn("status", _status())


def file_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("checksum").agg(*_counts()).withColumn("status", _status())


def all_files(split: DataFrame, ledger: DataFrame) -> DataFrame:
    """Imported files with their counts, and files refused as a whole with status FAILED."""
    counts = ["total_rows", "success_count", "updated_count", "skipped_count", "failed_count"]
    return (
        split.select("checksum", "file_path", "file_error")
        .join(file_summary(ledger), "checksum", "left")
        .select("checksum", "file_path",
                F.when(F.col("file_error").isNotNull(), "FAILED").otherwise(F.col("status")).alias("status"),
                *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
                F.col("file_error").alias("error_message"))
    )


def key_changes(decided: DataFrame) -> DataFrame:
    """Last supplied values of every key that changed, with its links; null where not supplied."""
    position = F.struct(*ORDER)
    supplied = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), position)).alias(name)
    sensor = F.when(F.col("sensor_value").isNotNull(), position)
    return (
        decided.where(F.col("outcome").isin("SUCCESS", "UPDATED")).groupBy(*KEY).agg(
            supplied("feed_amount_kg"), supplied("survival_rate"),
            *[F.max_by(c, sensor).alias(c) for c in
              ("sensor_value", "sensor_unit", "source_device", "device_id", "device_cage")],
            F.max_by("checksum", position).alias("import_id"),
            *[F.first(c, ignorenulls=True).alias(c) for c in
              ("active_batch_id", "active_fingerlings", "init")])
        .withColumn("business_key", text.business_key(*[F.col(c) for c in KEY]))
    )


def linked_records(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeding records, survival reports and readings to upsert by their number.

    An existing record keeps its number and batch; a new one gets a number from the business key
    and the cage's active batch.
    """
    init = F.col("init")
    has_record = init["record_batch_id"].isNotNull()
    has_report = init["report_batch_id"].isNotNull()
    number = lambda prefix: text.derived_no(prefix, F.col("business_key"))
    records = changes.where(F.col("feed_amount_kg").isNotNull()).select(
        F.when(has_record, init["record_no"]).otherwise(number("FR-")).alias("record_no"),
        F.when(~F.coalesce(has_record, F.lit(False)), F.col("active_batch_id")).alias("batch_id"),
        F.when(~F.coalesce(has_record, F.lit(False)), F.col("cage_no")).alias("cage_no"),
        F.when(~F.coalesce(has_record, F.lit(False)), F.lit(FEED_TYPE)).alias("feed_type"),
        F.col("feed_amount_kg").alias("amount_kg"), F.col("observed_at").alias("feeding_time"),
        # Posting is another job's business: an existing record keeps its own state.
        F.when(~F.coalesce(has_record, F.lit(False)), F.lit(0)).alias("posted"))
    is_new_report = ~F.coalesce(has_report, F.lit(False))
    stocked = F.when(has_report, init["report_fingerlings"]).otherwise(F.col("active_fingerlings"))
    reports = changes.where(F.col("survival_rate").isNotNull()).select(
        F.when(has_report, init["report_no"]).otherwise(number("SR-")).alias("report_no"),
        F.when(is_new_report, F.col("active_batch_id")).alias("batch_id"),
        F.when(is_new_report, F.col("cage_no")).alias("cage_no"),
        alive_count(F.col("survival_rate"), stocked).alias("alive_count"),
        "survival_rate", F.col("observed_at").alias("report_time"))
    readings = changes.where(F.col("sensor_value").isNotNull()).select(
        F.coalesce(init["reading_no"], number("RD-")).alias("reading_no"),
        F.col("device_id").alias("sensor_id"), F.col("device_cage").alias("cage_no"),
        F.col("sensor_value").alias("metric_value"), F.col("observed_at").alias("reading_time"))
    return records, reports, readings


def observation_changes(changes: DataFrame) -> DataFrame:
    """Rows for the upsert of the observation table; links only where the record is new."""
    init = F.col("init")
    number = lambda prefix: text.derived_no(prefix, F.col("business_key"))
    link = lambda measure, old, prefix: F.when(F.col(measure).isNotNull(), F.coalesce(old, number(prefix)))
    return changes.select(
        *KEY, *MEASURES,
        link("feed_amount_kg", F.when(init["record_batch_id"].isNotNull(), init["record_no"]), "FR-").alias("record_no"),
        link("survival_rate", F.when(init["report_batch_id"].isNotNull(), init["report_no"]), "SR-").alias("report_no"),
        link("sensor_value", init["reading_no"], "RD-").alias("reading_no"), "import_id")


# Whole job --------------------------------------------------------------------------------------

def decide(lines: DataFrame, tables: dict[str, DataFrame], now: dt.datetime | str,
           hot_rows: int | None = None, keep_outcomes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that failed validation, rows with an outcome) of numbered data lines.

    The parsed rows are written to the shared folder once, since several passes read columns of
    them; ``keep_outcomes`` does the same with the outcomes, for a caller who uses many outputs.
    """
    checked = stage(validate_rows(lines, now), "import-parsed")
    invalid = checked.where(F.col("err").isNotNull())
    sound = checked.where(F.col("err").isNull()).drop("err")
    hot = hot_keys_of(sound, hot_rows, cage=["cage_no"], device=["source_device"], key=KEY)
    rows = resolve_rows(
        sound, cage_reference(tables["fish_batch"], tables["harvest_batch"]), tables["sensor"], hot)
    stored = stored_state(tables["cage_observation"], sound, tables["feeding_record"],
                          tables["survival_report"], tables["fish_batch"], hot_rows)
    decided = replay(rows, stored, hot["key"])
    return invalid, stage(decided, "import-decided") if keep_outcomes else decided


def outputs(invalid: DataFrame, decided: DataFrame, shard_size: int = SHARD_SIZE,
            split: DataFrame | None = None, max_failures: int = 100) -> Import:
    ledger = row_ledger(invalid, decided, shard_size)
    changes = key_changes(decided)
    files = file_summary(ledger) if split is None else all_files(split, ledger)
    return Import(ledger, shard_summary(ledger), files, first_failures(ledger, limit=max_failures),
                  observation_changes(changes), *linked_records(changes))


def import_lines(lines: DataFrame, tables: dict[str, DataFrame], now: dt.datetime | str,
                 shard_size: int = SHARD_SIZE, hot_rows: int | None = None,
                 keep_outcomes: bool = False) -> Import:
    """Import of numbered data lines (checksum, file_time, line_no, data_idx, raw_line)."""
    return outputs(*decide(lines, tables, now, hot_rows, keep_outcomes), shard_size)


def import_observations(spark: SparkSession, path: str | Sequence[str], tables: dict[str, DataFrame],
                        now: dt.datetime | str, shard_size: int = SHARD_SIZE,
                        imported: DataFrame | None = None, files: DataFrame | None = None,
                        hot_rows: int | None = None, expected: DataFrame | None = None) -> Import:
    """Import of all files under ``path`` that ``imported`` (earlier file summaries) does not hold.

    ``files`` may name them, as from ``scan_files``. Files that ``expected`` (file_path,
    expected_checksum) gives another checksum are refused as a whole and stay open for a later import; files
    already imported stay as they are.
    """
    found = scan_files(spark, path) if files is None else files
    refused = None
    if expected is not None:
        found, refused = verify_checksum(found, expected)
        if imported is not None:
            refused = refused.join(imported.select("checksum"), "checksum", "left_anti")
    kept = stage(dedup_files(found, imported), "import-new-files")
    numbered = stage(read_obs_files(spark, path, kept, hot_rows), "import-lines")
    judged = stage(judge_files(kept, numbered), "import-files")
    lines = data_lines(judged, numbered, hot_rows)
    invalid, decided = decide(lines, tables, now, hot_rows, keep_outcomes=True)
    result = outputs(invalid, decided, shard_size, judged)
    if refused is None:
        return result
    counts = ["total_rows", "success_count", "updated_count", "skipped_count", "failed_count"]
    return result._replace(files=result.files.unionByName(refused.select(
        "checksum", "file_path", F.lit("FAILED").alias("status"),
        *[F.lit(0).cast("bigint").alias(c) for c in counts], F.when(
            F.col("expected_checksum") == NO_EXPECTATION, REFUSED[0]).otherwise(REFUSED[1]).alias("error_message"))))
