"""Which entities may be deleted, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _with_flag(df: DataFrame, guard: DataFrame, key: str, flag: str) -> DataFrame:
    """Flag rows whose key occurs in the guard; the guard is reduced to its distinct keys first."""
    keys = guard.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left")


def _judge(df: DataFrame, key: str, reason: Column) -> DataFrame:
    return df.select(key, reason.isNull().cast("int").alias("deletable"), reason.alias("reason"))


def deletable_batches(batches: DataFrame, harvests: DataFrame, records: DataFrame) -> DataFrame:
    accepted = harvests.where(F.col("status") == "ACCEPTED")
    posted = records.where(F.col("posted") == 1)
    flagged = _with_flag(_with_flag(batches, accepted, "batch_id", "harvested"),
                         posted, "batch_id", "fed")
    return _judge(flagged, "batch_id", F.when(F.col("harvested"), "accepted_harvest")
                  .when(F.col("fed"), "posted_feed"))


def deletable_sensors(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    return _judge(_with_flag(sensors, readings, "sensor_id", "used"), "sensor_id",
                  F.when(F.col("used"), "has_readings"))


def deletable_records(records: DataFrame) -> DataFrame:
    return _judge(records, "record_id", F.when(F.col("posted") == 1, "posted"))


def deletable_harvests(harvests: DataFrame) -> DataFrame:
    return _judge(harvests, "harvest_id", F.when(F.col("status") == "ACCEPTED", "accepted"))


def deletable_rules(rules: DataFrame) -> DataFrame:
    return _judge(rules, "rule_id", F.when(F.col("status") != "DRAFT", "not_draft"))


def deletable(kind: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, deletable 0/1, reason) for one kind of entity."""
    checks = {
        "fish_batch": lambda: deletable_batches(
            tables["fish_batch"], tables["harvest_batch"], tables["feeding_record"]),
        "sensor": lambda: deletable_sensors(tables["sensor"], tables["sensor_reading"]),
        "feeding_record": lambda: deletable_records(tables["feeding_record"]),
        "harvest_batch": lambda: deletable_harvests(tables["harvest_batch"]),
        "ts_rule": lambda: deletable_rules(tables["ts_rule"]),
    }
    return checks[kind]()
