"""Weighted feed per batch and business date: tides, local minute, rules, exact sums."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from netpen.functions import times
from netpen.operators.hot import skew_join
from netpen.operators.ranges import day_segments, range_join, rules_by_minute
from netpen.session import stage
from netpen.sources.snapshots import rule_snapshot

# Fixed values.
RULE_TYPES = ["PEAK", "FLAT", "VALLEY"]


class RuleCalc(NamedTuple):
    results: DataFrame
    details: DataFrame
    rejected: DataFrame


def enabled(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("status") == "ENABLED")


def _targets(requests: DataFrame, batches: DataFrame, sea_areas: DataFrame) -> DataFrame:
    return (
        requests.select("batch_id", "business_date").distinct()
        .join(batches.select("batch_id", "cage_no", F.lit(True).alias("known")), "batch_id", "left")
        .join(sea_areas.select("cage_no", "time_zone"), "cage_no", "left")
    )


def placed_observations(targets: DataFrame, tides: DataFrame, observations: DataFrame,
                        hot_rows: int | None = None) -> DataFrame:
    """Observations inside the requested days' envelopes, with their tide where one holds them.

    The observations meet the segments of their batch's cage, which are as many as the cage has, whatever
    the number of its batches; the day's disjoint segments take the place of a separate envelope join, tide
    join and choice of the first tide. Then only requested days are kept.
    """
    wanted = targets.select("batch_id", "business_date", "cage_no", "time_zone")
    homes = wanted.select("batch_id", "cage_no").distinct()
    located = stage(skew_join(
        observations.select("obs_id", "obs_no", "batch_id", "observed_at_utc", "feed_amount_kg"), homes,
        ["batch_id"], ["obs_id"], "inner", hot_rows), "located-observations")
    placed = range_join(located, day_segments(tides, hot_rows), ["cage_no"], "observed_at_utc", "seg_start", "seg_end",
                        ["obs_id"], hot_rows)
    return skew_join(stage(placed, "placed-observations"), wanted, ["batch_id", "business_date", "cage_no"], ["obs_id"],
                     "inner", hot_rows)


def affected_days(observations: DataFrame, batches: DataFrame, tides: DataFrame,
                  hot_rows: int | None = None) -> DataFrame:
    """(batch_id, business_date) pairs whose result the observations have a part in."""
    homes = batches.select("batch_id", "cage_no")
    located = skew_join(observations.select("obs_id", "batch_id", "observed_at_utc"), homes,
                        ["batch_id"], ["obs_id"], "inner", hot_rows)
    segments = day_segments(tides, hot_rows).select("cage_no", "business_date", "seg_start", "seg_end")
    return range_join(located, segments, ["cage_no"], "observed_at_utc", "seg_start", "seg_end",
                      ["obs_id"], hot_rows).select("batch_id", "business_date").distinct()


def recalculate(requests: DataFrame, batches: DataFrame, sea_areas: DataFrame, tides: DataFrame,
                observations: DataFrame, rules: DataFrame,
                hot_rows: int | None = None) -> RuleCalc:
    """Results and details for all requested (batch_id, business_date) pairs in one plan.

    Uses the batch's present cage, that cage's present zone and the rules now enabled; pass other
    tables for another moment.
    """
    active = enabled(rules)
    has_rules = active.agg((F.count(F.lit(1)) > 0).alias("has_rules")).scalar()
    targets = _targets(requests, batches, sea_areas).withColumn(
        "reason",
        F.when(F.col("known").isNull(), "batch_missing")
        .when(F.col("time_zone").isNull(), "no_sea_area")
        .when(~has_rules, "no_enabled_rule")).drop("known")
    good = targets.where(F.col("reason").isNull()).drop("reason")

    local = times.to_local(F.col("observed_at_utc"), F.col("time_zone"))
    by_minute = rules_by_minute(active)
    matched = (
        placed_observations(good, tides, observations, hot_rows)
        .withColumn("local_time", local)
        .withColumn("minute", F.when(F.col("in_tide"), times.minute_of_day(F.col("local_time"))))
        # At most 1440 rows, see rules_by_minute.
        .join(F.broadcast(by_minute), "minute", "left")
        .withColumn("weighted_kg", F.col("feed_amount_kg") * F.col("coefficient"))
    )

    total = lambda amount: F.sum(amount)
    sums = matched.groupBy("batch_id", "business_date").agg(
        F.count(F.lit(1)).alias("obs_total"),
        F.count("weighted_kg").alias("obs_matched"),
        *[total(F.when(F.col("rule_type") == t, F.col("weighted_kg"))).alias(f"{t.lower()}_total_kg")
          for t in RULE_TYPES],
        total(F.col("weighted_kg")).alias("total_weighted_kg"))
    rounded = lambda name: F.round(F.coalesce(name, F.lit(0)), 2).cast("decimal(18,2)").alias(name)
    count = lambda name: F.coalesce(name, F.lit(0).cast("bigint"))
    results = (
        good.select("batch_id", "business_date", "cage_no")
        .join(sums, ["batch_id", "business_date"], "left")
        .select(
            "batch_id", "cage_no", "business_date",
            count("obs_total").alias("obs_total"), count("obs_matched").alias("obs_matched"),
            (count("obs_total") - count("obs_matched")).alias("obs_unmatched"),
            *[rounded(f"{t.lower()}_total_kg") for t in RULE_TYPES], rounded("total_weighted_kg"),
            rule_snapshot(active).scalar().alias("rule_snapshot"))
    )
    details = matched.where(F.col("weighted_kg").isNotNull()).select(
        "batch_id", "business_date", "obs_id", "obs_no", "observed_at_utc",
        times.clock(F.col("local_time")).alias("obs_local_time"),
        "tide_id", "tide_no", F.col("start_at_utc").alias("tide_start_utc"),
        F.col("end_at_utc").alias("tide_end_utc"),
        "rule_id", "rule_code", F.col("version_no").alias("rule_version"), "rule_type",
        "coefficient", "feed_amount_kg", F.col("weighted_kg").cast("decimal(18,8)").alias("weighted_kg"))
    rejected = targets.where(F.col("reason").isNotNull()).select(
        "batch_id", "business_date", "reason")
    return RuleCalc(results, details, rejected)
