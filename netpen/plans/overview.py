"""Cage overview and batch detail as flat tables keyed by cage or batch.

Nested lists are left as rows: a cage's sensors or a batch's feeding records have no upper bound,
so gathering them into one value would put a whole group into one task. Filter by the key and use
the listing orders for the single-cage or single-batch view.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from netpen.operators.hot import skew_join
from netpen.operators.latest import latest


class CageOverview(NamedTuple):
    cages: DataFrame
    batches: DataFrame
    sensors: DataFrame
    harvests: DataFrame


class BatchDetail(NamedTuple):
    batches: DataFrame
    feeding_records: DataFrame
    survival_reports: DataFrame
    harvests: DataFrame


def posted_feed(records: DataFrame) -> DataFrame:
    """Posted amount per batch; batches without posted records are absent."""
    return (
        records.where(F.col("posted") == 1).groupBy("batch_id")
        .agg(F.sum("amount_kg").cast("decimal(18,2)").alias("posted_feed_kg"))
    )


def posted_feed_by_batch(batches: DataFrame, records: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return batches.join(posted_feed(records), "batch_id", "left").withColumn(
        "posted_feed_kg", F.coalesce("posted_feed_kg", zero))


def latest_survival(reports: DataFrame) -> DataFrame:
    return latest(reports, "batch_id", "report_time", "report_id",
                  ["alive_count", "survival_rate"])


def latest_reading(readings: DataFrame) -> DataFrame:
    return latest(readings, "sensor_id", "reading_time", "reading_id", ["metric_value"])


def reading_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("reading_count"))


def cage_batches(batches: DataFrame, records: DataFrame, reports: DataFrame) -> DataFrame:
    """Non-closed batches with their posted feed and newest survival rate."""
    shown = batches.where(F.col("status") != "CLOSED").select(
        "cage_no", "batch_id", "batch_no", "species", "fingerling_count", "status", "stocking_time")
    newest = latest_survival(reports).select(
        "batch_id", F.col("survival_rate").alias("latest_survival_rate"))
    return posted_feed_by_batch(shown, records).join(newest, "batch_id", "left")


def cage_feed_total(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Posted feed of the non-closed batches now in each cage, wherever it was fed."""
    shown = batches.where(F.col("status") != "CLOSED").select("cage_no", "batch_id")
    return posted_feed_by_batch(shown, records).groupBy("cage_no").agg(
        F.sum("posted_feed_kg").cast("decimal(18,2)").alias("posted_feed_kg"))


def sensor_latest(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    newest = latest_reading(readings).select(
        "sensor_id", F.col("metric_value").alias("latest_value"),
        F.col("reading_time").alias("latest_reading_time"))
    return sensors.join(newest, "sensor_id", "left")


def cage_overview(batches: DataFrame, records: DataFrame, reports: DataFrame, sensors: DataFrame,
                  readings: DataFrame, harvests: DataFrame) -> CageOverview:
    """All cages at once."""
    sensor_rows = sensor_latest(
        sensors.select("cage_no", "sensor_id", "sensor_no", "sensor_type", "metric_unit", "status"),
        readings)
    harvest_rows = harvests.select(
        "cage_no", "harvest_id", "harvest_no", "harvest_count", "total_weight_kg", "status",
        "harvest_time")
    known = union_all([t.select("cage_no") for t in (batches, sensors, harvests)]).distinct()
    zero = F.lit(0).cast("decimal(18,2)")
    cages = known.join(cage_feed_total(batches, records), "cage_no", "left").withColumn(
        "posted_feed_kg", F.coalesce("posted_feed_kg", zero))
    return CageOverview(cages, cage_batches(batches, records, reports), sensor_rows, harvest_rows)


def union_all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def batch_detail(batches: DataFrame, records: DataFrame, reports: DataFrame, harvests: DataFrame,
                 hot_rows: int | None = None) -> BatchDetail:
    """Batches with their posted total, and their records, reports and harvests as rows."""
    keys = batches.select("batch_id")
    of_batch = lambda rows, row_id: skew_join(
        rows, keys, ["batch_id"], [row_id], "left_semi", hot_rows)
    return BatchDetail(
        posted_feed_by_batch(batches, records), of_batch(records, "record_id"),
        of_batch(reports, "report_id"), of_batch(harvests, "harvest_id"))
