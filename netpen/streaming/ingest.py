"""Streams over arriving observation files and arriving feed observations.

Both work in ``foreachBatch``, whose batch may be delivered again after a failure. An import first
writes everything it decided under the batch's number and only then applies it; a second delivery
finds that and applies the same changes again, which leaves the tables as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from netpen.plans.importer import REFUSED, SHARD_SIZE, Import, import_observations
from netpen.plans.rulecalc import affected_days, recalculate
from netpen.schemas import FEED_OBSERVATION, IMPORT_FILE, TABLES
from netpen.session import configure, stage, staging
from netpen.sources.obs_files import EMPTY_CHECKSUM, NO_EXPECTATION, empty_files, scan_files, with_checksum
from netpen.sources.sinks import (
    OBSERVATION_KEY, read_or_empty, replace_table, upsert_table, write_ledger, write_partitions)
from netpen.sources.tables import conform
from netpen.sources.versions import Version, change, day_of, days_of, open_version

WATERMARKS = "spark.sql.streaming.multipleWatermarkPolicy"

Tables = Callable[[], dict[str, DataFrame]]

# Result -> (table, key, time column, condition under which a stored row stays as it is).
_UPSERTS = {
    "observations": ("cage_observation", OBSERVATION_KEY, "observed_at", None),
    "feeding_records": ("feeding_record", ["record_no"], "feeding_time", "posted = 1"),
    "survival_reports": ("survival_report", ["report_no"], "report_time", None),
    "sensor_readings": ("sensor_reading", ["reading_no"], "reading_time", None),
}


def stored_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """Published tables, bucketed by their keys and filed by ``day``."""
    return {name: open_version(spark, f"{root}/{name}", TABLES[name]) for name in names}


def _decided(spark: SparkSession, run_path: str) -> Import | None:
    """What an earlier delivery of the same batch decided, if it got that far."""
    try:
        spark.read.parquet(f"{run_path}/done")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Import(*[spark.read.parquet(f"{run_path}/{name}") for name in Import._fields])


def apply_import(spark: SparkSession, root: str, result: Import) -> None:
    """Write an import's outputs: four upserts, then the row, shard and file ledgers.

    Records posted since the decision keep what was posted.
    """
    for field, (table, keys, time, locked) in _UPSERTS.items():
        upsert_table(spark, f"{root}/{table}", table, getattr(result, field), keys, time,
                     None if locked is None else F.expr(locked))
    write_ledger(result.ledger, f"{root}/import_row")
    write_partitions(result.shards, f"{root}/import_shard", ["checksum"])
    write_partitions(conform(result.files, IMPORT_FILE), f"{root}/import_file", ["checksum"])


def import_files(spark: SparkSession, path: str | Sequence[str], files: DataFrame, root: str,
                 reference: dict[str, DataFrame], now: dt.datetime | str, run: str,
                 shard_size: int = SHARD_SIZE, expected: DataFrame | None = None) -> Import:
    """One import run into the tables under ``root``; repeating a run is harmless.

    ``run`` names the run for good: with other files under the same name it raises.
    """
    run_path = f"{root}/import_run/{run}"
    sums = files.select("checksum").distinct()
    result = _decided(spark, run_path)
    if result is None:
        tables = {**reference, **stored_tables(
            spark, root, "cage_observation", "feeding_record", "survival_report")}
        # Files refused for their checksum stay open.
        imported = read_or_empty(spark, f"{root}/import_file", IMPORT_FILE).where(
            F.col("error_message").isNull() | ~F.col("error_message").isin(*REFUSED))
        found = import_observations(spark, path, tables, now, shard_size, imported, files, expected=expected)
        for name, df in found._asdict().items():
            df.write.mode("overwrite").parquet(f"{run_path}/{name}")
        sums.write.mode("overwrite").parquet(f"{run_path}/done")
        result = _decided(spark, run_path)
    elif not _same(sums, spark.read.parquet(f"{run_path}/done")):
        raise ValueError(f"run {run} has imported other files before")
    apply_import(spark, root, result)
    return result


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def import_folder(spark: SparkSession, path: str, root: str, reference: dict[str, DataFrame],
                  now: dt.datetime | str, run: str, shard_size: int = SHARD_SIZE,
                  expected: DataFrame | None = None) -> Import:
    with staging(configure(spark)):
        return import_files(spark, path, scan_files(spark, path), root, reference, now, run, shard_size, expected)


def with_expectations(files: DataFrame, expected: DataFrame, wait: str) -> DataFrame:
    """Streams of files and of (file_path, expected_checksum), each with ``seen_at``, joined by path in state.

    Either may come first, by up to ``wait`` (an interval such as ``2 hours``). A file without an expectation by
    then leaves with ``NO_EXPECTATION``; an expectation without a file by then is forgotten.
    """
    left = files.withWatermark("seen_at", "1 second")
    right = expected.select(F.col("file_path").alias("for_path"), "expected_checksum",
                            F.col("seen_at").alias("told_at")).withWatermark("told_at", "1 second")
    near = (F.col("told_at") >= F.col("seen_at") - F.expr(f"interval {wait}")) & (
        F.col("told_at") <= F.col("seen_at") + F.expr(f"interval {wait}"))
    joined = left.join(right, (F.col("file_path") == F.col("for_path")) & near, "left_outer")
    return joined.select(*files.columns, F.when(
        F.col("for_path").isNull(), NO_EXPECTATION).otherwise(F.col("expected_checksum")).alias("expected_checksum"))


def report_empty(spark: SparkSession, path: str, root: str) -> None:
    """Enter files without bytes in the file ledger; no batch of the stream holds a row of them."""
    empty = empty_files(spark, path).where(F.col("checksum") == EMPTY_CHECKSUM).groupBy("checksum").agg(
        F.min("file_path").alias("file_path"), F.lit("FAILED").alias("status"), F.lit("bad_header").alias("error_message"),
        *[F.lit(0).cast("bigint").alias(c) for c in (
            "total_rows", "success_count", "updated_count", "skipped_count", "failed_count")])
    write_partitions(conform(empty, IMPORT_FILE), f"{root}/import_file", ["checksum"])


def stream_imports(spark: SparkSession, path: str, root: str, checkpoint: str, reference: Tables,
                   clock: Callable[[], dt.datetime], shard_size: int = SHARD_SIZE,
                   files_per_batch: int = 1000, expected: DataFrame | None = None,
                   wait: str = "1 day") -> StreamingQuery:
    """Import files as they arrive, each once; corrections come as new files.

    Runs over what is there and stops; start it again with the same checkpoint for later files.
    ``reference`` gives fish_batch, harvest_batch and sensor for each batch, ``clock`` its time. Several
    streams may share ``root``: a run is named by the id in the stream's checkpoint and its batch.

    With ``expected``, a stream of (file_path, expected_checksum), a file waits for its expectation and is refused
    if that differs (``checksum_mismatch``) or has not come within ``wait`` (``checksum_missing``), as judged
    when something arrives after that. A blank expectation accepts its file. Files without bytes are reported
    when the stream is started.
    """
    configure(spark)
    report_empty(spark, path, root)
    arriving = (
        spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(path))
    if expected is not None:
        seen = F.current_timestamp().alias("seen_at")
        arriving = with_expectations(with_checksum(arriving, "path", seen),
                                     expected.select("file_path", "expected_checksum", seen), wait)

    def one_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = session.read.json(f"{checkpoint}/metadata").first()["id"]
        with staging(session):
            files = stage(with_checksum(batch, "path") if expected is None else batch, "arrived-files")
            told = None
            if expected is not None:
                # Of several expectations that a file meets at once, any may accept it.
                told = files.select("file_path", "expected_checksum")
                files = files.drop("expected_checksum", "seen_at").dropDuplicates(["file_path"])
            # At most ``files_per_batch`` names, and those that waited.
            paths = [row.path for row in files.select("path").collect()]
            if paths:
                import_files(session, paths, files.drop("path"), root, reference(), clock(),
                             f"stream={stream}/batch={number}", shard_size, told)

    policy = spark.conf.get(WATERMARKS)
    # Both sides' times are arrival times, so no row can come late, and a silent side must not hold up the other.
    spark.conf.set(WATERMARKS, "max")
    try:
        return (arriving.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(WATERMARKS, policy)


def store_observations(spark: SparkSession, path: str, arrived: DataFrame) -> None:
    """Publish arrived observations whose number is new; of the stored ones only the numbers are compared."""
    rows = conform(arrived.dropDuplicates(["obs_no"]), FEED_OBSERVATION).withColumn("day", day_of("observed_at_utc"))

    def build(version: Version) -> tuple[DataFrame, Sequence] | None:
        stored = open_version(spark, path, FEED_OBSERVATION, version)
        fresh = stage(rows.join(stored.select("obs_no"), "obs_no", "left_anti"), "fresh-observations")
        days = days_of(fresh)
        if not days:
            return None
        return stored.where(F.col("day").isin(days)).unionByName(fresh), days

    change(spark, path, ["obs_no"], build)


def observations_of(spark: SparkSession, path: str, pairs: DataFrame, batches: DataFrame,
                    tides: DataFrame) -> DataFrame:
    """Stored observations that may fall into the (batch_id, business_date) pairs.

    The days between a business date's first tide and its last select folders, the batches' range row groups,
    so what is read follows the pairs, not the history.
    """
    version = Version(spark, path)
    stored = open_version(spark, path, FEED_OBSERVATION, version)
    if not version.folders:
        return stored.drop("day")
    wanted = pairs.join(batches.select("batch_id", "cage_no"), "batch_id")
    spans = tides.groupBy("cage_no", "business_date").agg(
        F.greatest(F.to_date(F.min("start_at_utc")), F.lit(min(version.folders))).alias("lo"),
        F.least(F.to_date(F.max("end_at_utc")), F.lit(max(version.folders))).alias("hi"))
    # Within the days that the table has, so a few thousand at most.
    bounds = wanted.join(spans, ["cage_no", "business_date"]).where("lo <= hi").select(
        "batch_id", F.explode(F.sequence("lo", "hi")).alias("day")).agg(
        F.min("batch_id").alias("lo"), F.max("batch_id").alias("hi"), F.collect_set("day").alias("days")).first()
    return stored.where(F.col("day").isin(bounds.days) & F.col("batch_id").between(
        F.lit(bounds.lo), F.lit(bounds.hi))).drop("day")


def recalculate_late(spark: SparkSession, arrived: DataFrame, root: str,
                     reference: dict[str, DataFrame]) -> None:
    """Store new observations and recompute every (batch, business date) they fall into."""
    path = f"{root}/feed_observation"
    batches, tides = reference["fish_batch"], reference["tide_session"]
    store_observations(spark, path, arrived)
    # Judged on all arrived rows, so that a second delivery recomputes the same days.
    pairs = stage(affected_days(arrived, batches, tides), "affected-days")
    calc = recalculate(pairs, batches, reference["cage_sea_area"], tides,
                       observations_of(spark, path, pairs, batches, tides), reference["ts_rule"])
    replace_table(spark, f"{root}/calc_result", calc.results, pairs, ["batch_id", "business_date"])
    replace_table(spark, f"{root}/calc_detail", calc.details, pairs, ["obs_id"])


def stream_recalculation(spark: SparkSession, source: DataFrame, root: str, checkpoint: str,
                         reference: Tables) -> StreamingQuery:
    """Recalculate as feed observations arrive on a streaming DataFrame."""
    configure(spark)

    def one_batch(batch: DataFrame, number: int) -> None:
        with staging(batch.sparkSession):
            recalculate_late(batch.sparkSession, batch, root, reference())

    return (source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
