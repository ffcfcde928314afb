"""JSON snapshots: the rule list of a calculation and the hand-off of a migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netpen.schemas import HANDOFF_SNAPSHOT, RULE_SNAPSHOT


def rule_snapshot(rules: DataFrame) -> DataFrame:
    """One row with the JSON list of the enabled rules by (start, code).

    Enabled rules do not share a minute, so a sound rule table has at most 1440 of them.
    """
    item = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_code").alias("ruleCode"),
        F.col("version_no").alias("versionNo"), F.col("rule_type").alias("ruleType"),
        F.col("start_minute").alias("startMinute"), F.col("end_minute").alias("endMinute"),
        F.col("coefficient").alias("coefficient"))
    entries = F.array_sort(F.collect_list(F.struct("start_minute", "rule_code", item.alias("item"))))
    return rules.agg(F.to_json(F.transform(entries, lambda e: e["item"])).alias("rule_snapshot"))


def decode_rules(col: Column) -> Column:
    return F.from_json(col, RULE_SNAPSHOT)


def decode_handoff(col: Column) -> Column:
    return F.from_json(col, HANDOFF_SNAPSHOT)


def decode_sides(col: Column) -> Column:
    """Only what both sides of a hand-off must agree on."""
    side = ("struct<fishEstimateCount:int,cumulativePostedFeedKg:decimal(18,2),"
            "latestSurvivalRate:decimal(7,4),feedingPlanCount:bigint,movedSensorCount:bigint,movedSensors:array<struct<id:bigint>>>")
    return F.from_json(col, f"struct<source:{side},target:{side}>")
