"""Replay of status changes: which moves are legal, and the state after them.

Every lifecycle here only climbs: statuses that may follow each other freely share a level, and a
move is legal when its level is not below the present one. The present level is then the highest
level asked for so far (a refused move asks for a lower one, so it never counts), which makes the
replay an ordered running maximum instead of a step-by-step fold.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from netpen.functions.times import ntz
from netpen.operators.hot import OrderedScan, skew_join
from netpen.plans.overview import union_all
from netpen.session import stage

STRETCH_ROWS = 200_000  # requests to enable rules that one task takes

# Statuses that may follow each other share a level.
LEVELS = {
    "fish_batch": {"BREEDING": 0, "MONITORING": 0, "HARVESTED": 1, "CLOSED": 2},
    "feeding_plan": {"ACTIVE": 0, "SUSPENDED": 0, "FINISHED": 1},
    "sensor": {"ONLINE": 0, "OFFLINE": 0, "MAINTENANCE": 0},
}
ENTITY_KEY = {"fish_batch": "batch_id", "feeding_plan": "plan_id", "sensor": "sensor_id"}


class Replay(NamedTuple):
    events: DataFrame
    final: DataFrame


class Enabling(NamedTuple):
    rules: DataFrame
    rejected: DataFrame


def _level(kind: str, status: Column) -> Column:
    levels = F.create_map(*[F.lit(v) for pair in LEVELS[kind].items() for v in pair])
    return F.try_element_at(levels, status)


def replay_status(kind: str, entities: DataFrame, events: DataFrame,
                  hot_rows: int | None = None) -> Replay:
    """Events (event_id, entity key, event_time, target_status) with verdict, and final statuses."""
    key = ENTITY_KEY[kind]
    start = entities.select(
        key, F.lit(None).cast("timestamp_ntz").alias("event_time"), F.lit(None).cast("bigint").alias("event_id"),
        F.col("status").alias("target_status"))
    every = events.withColumn("is_event", F.lit(True)).unionByName(
        start.withColumn("is_event", F.lit(False)), allowMissingColumns=True)
    every = every.withColumn("level", _level(kind, F.col("target_status")))
    scan = OrderedScan(every, [key], ["event_time", "event_id"], hot_rows=hot_rows)
    scan.carry(maximum={"level_before": F.col("level"), "known": F.when(~F.col("is_event"), 1)})
    legal = F.col("level") >= F.col("level_before")
    reason = (
        F.when(F.col("known").isNull(), "entity_missing")
        .when(F.col("level").isNull(), "bad_status").when(~legal, "illegal_move"))
    scan.add(reason=F.when(F.col("is_event"), reason))
    scan.carry(last={"status_before": F.when(F.col("reason").isNull(), F.col("target_status"))})
    rows = scan.rows()
    judged = rows.where(F.col("is_event")).select(
        *events.columns, F.when(F.col("known") == 1, F.col("status_before")).alias("status_before"),
        F.col("reason").isNull().cast("int").alias("accepted"), "reason")
    position = F.struct("event_time", "event_id")
    final = (
        rows.where(F.col("reason").isNull()).groupBy(key)
        .agg(F.max_by("target_status", position).alias("status"),
             F.count_if(F.col("is_event")).alias("moves")))
    return Replay(judged, final)


def replay_harvests(batches: DataFrame, harvests: DataFrame, acceptances: DataFrame,
                    batch_events: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, Replay]:
    """Acceptances (event_id, harvest_id, event_time) with verdict, and the batches' replay.

    An acceptance moves its batch to HARVESTED. It is refused when the harvest is missing or already
    accepted, or when the batch is closed by then; a refused one asks for a level the batch already
    has, so it may stay in the batch's event stream.
    """
    known = harvests.select("harvest_id", "batch_id", F.col("status").alias("stored_status"))
    asked = skew_join(acceptances, known, ["harvest_id"], ["event_id"], "left", hot_rows)
    moves = asked.where(F.col("batch_id").isNotNull() & (F.col("stored_status") != "ACCEPTED")).select(
        "event_id", "batch_id", "event_time", F.lit("HARVESTED").alias("target_status"), "harvest_id")
    merged = batch_events.unionByName(moves, allowMissingColumns=True)
    replay = replay_status("fish_batch", batches, merged, hot_rows)
    verdicts = replay.events.where(F.col("harvest_id").isNotNull()).select(
        "event_id", F.col("reason").alias("batch_reason"))
    firsts = moves.groupBy("harvest_id").agg(
        F.min_by("event_id", F.struct("event_time", "event_id")).alias("event_id")).select(
        "event_id", F.lit(True).alias("is_first"))
    judged = asked.join(verdicts, "event_id", "left").join(firsts, "event_id", "left")
    reason = (
        F.when(F.col("batch_id").isNull(), "harvest_missing")
        .when(F.col("stored_status") == "ACCEPTED", "already_accepted")
        .when(F.col("batch_reason").isNotNull(), "batch_closed")
        .when(F.col("is_first").isNull(), "already_accepted"))
    return judged.select("event_id", "harvest_id", "batch_id", "event_time",
                         reason.isNull().cast("int").alias("accepted"), reason.alias("reason")), replay


def replay_rules(rules: DataFrame, events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Events (event_id, rule_id, event_time, action ENABLE / RETIRE) of rule versions with verdict.

    Versions begin in their stored ``status`` (null: DRAFT). A version is enabled once, from DRAFT; that retires
    all enabled versions of its code at that moment. Retiring needs the version to be enabled then: by its
    own enabling, with none of its code after it, or as stored, with none of its code so far. Overlap with
    other codes is the business of ``rule_overlaps``.

    The events are written once with their rule, and each scan takes only the rows that its question is
    about: drafts' enablings by version, those that take and all retirings by code, those that hold by version.
    """
    known = rules.select("rule_id", "rule_code", F.coalesce("status", F.lit("DRAFT")).alias("stored"))
    asked = stage(events.select("event_id", "rule_id", "event_time", "action"), "rule-events")
    rows = stage(skew_join(asked, known, ["rule_id"], ["event_id"], "left", hot_rows), "known-rule-events")
    order = ["event_time", "event_id"]
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    enables, retires = F.col("action") == "ENABLE", F.col("action") == "RETIRE"
    missing, drafts = F.col("rule_code").isNull(), yes(enables) & yes(F.col("stored") == "DRAFT")
    version = OrderedScan(rows.where(~missing & drafts), ["rule_id"], order, hot_rows=hot_rows)
    version.carry(count="enabled_before")
    enabling = stage(version.rows().withColumn("takes", F.col("enabled_before") == 0).drop("enabled_before"), "draft-enablings")
    about_code = rows.where(~missing & yes(retires)).withColumn("takes", F.lit(False)).unionByName(enabling.where("takes"))
    code = OrderedScan(about_code, ["rule_code"], order, hot_rows=hot_rows)
    code.carry(last={"holder": F.when(F.col("takes"), F.col("rule_id"))})
    as_stored = F.col("holder").isNull() & (F.col("stored") == "ENABLED")
    code.add(holds=yes((F.col("holder") == F.col("rule_id")) | as_stored))
    retiring = stage(code.rows().where(retires).drop("takes", "holder"), "retirings")
    held = OrderedScan(retiring.where("holds"), ["rule_id"], order, hot_rows=hot_rows).carry(count="retired_before").rows()
    accepted = F.lit(None).cast("string")
    judged = [
        rows.where(missing).withColumn("reason", F.lit("rule_missing")),
        rows.where(~missing & ~drafts & ~yes(retires)).withColumn(
            "reason", F.when(enables, "not_draft").when(~enables & ~retires, "bad_action")),
        enabling.withColumn("reason", F.when(F.col("takes"), accepted).otherwise("not_draft")),
        retiring.where("not holds").withColumn("reason", F.lit("not_enabled")),
        held.withColumn("reason", F.when(F.col("retired_before") > 0, "not_enabled"))]
    return union_all([part.select(
        "event_id", "rule_id", "event_time", "action", F.col("reason").isNull().cast("int").alias("accepted"), "reason")
        for part in judged])


def rule_history(rules: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Versions that were enabled, each with its end: its own retirement or the next enabling."""
    rows = rules.where(F.col("enabled_time").isNotNull()).withColumn(
        "__from_end", -F.unix_micros(F.col("enabled_time").cast("timestamp")))
    rows = rows.withColumn("__id_from_end", -F.col("rule_id"))
    scan = OrderedScan(rows, ["rule_code"], ["__from_end", "__id_from_end"], hot_rows=hot_rows)
    following = scan.carry(last={"next_enabled": F.col("enabled_time")}).rows()
    return following.select(
        "rule_id", "rule_code", "version_no", "enabled_time",
        F.least("retired_time", "next_enabled").alias("retired_time"))


def _enable_in_order(requests, enabled):
    """Verdicts of one stretch of requests, in order, and the rules enabled after it.

    ``enabled`` holds the rules enabled before: per minute of the day how many, and the same per code.
    """
    total, by_code, standing = np.zeros(1440, np.int32), {}, {}

    def minutes(start, end):
        return np.arange(start, end if end > start else end + 1440) % 1440

    def put(code, rule, start, end):
        at = minutes(start, end)
        total[at] += 1
        by_code.setdefault(code, np.zeros(1440, np.int32))[at] += 1
        standing.setdefault(code, []).append((rule, start, end))

    for r in enabled.itertuples():
        put(r.rule_code, r.rule_id, r.start_minute, r.end_minute)
    granted, out = set(), []
    for r in requests.sort_values("request_id").itertuples():
        reason = None
        if r.status != "DRAFT" or r.rule_id in granted:
            reason = "not_draft"
        else:
            at, own = minutes(r.start_minute, r.end_minute), by_code.get(r.rule_code)
            if ((total[at] - (own[at] if own is not None else 0)) > 0).any():
                reason = "overlaps_enabled_rule"
        out.append((r.request_id, reason))
        if reason is None:
            if own is not None:
                total[:] -= own
                own[:] = 0
            standing[r.rule_code] = []
            put(r.rule_code, r.rule_id, r.start_minute, r.end_minute)
            granted.add(r.rule_id)
    left = [(code, *rule) for code, rules in standing.items() for rule in rules]
    return out, left


def _stretches(sound: DataFrame, enabled: DataFrame, rows: int) -> DataFrame:
    """``request_id`` and ``reason`` of sound requests, taken in order by stretches of about ``rows``.

    What a stretch hands on is the rules enabled after it; enabled rules of different codes share no minute,
    so there are few of them, and a draft that was enabled, which the next stretches look up by its id.
    """
    cuts = sound.agg(F.count("*").alias("n"), F.min("request_id").alias("first")).first()
    parts = -(-cuts["n"] // rows)
    ends = sound.agg(F.percentile_approx("request_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = [None, *sorted(set(ends)), None]
    verdicts: list[DataFrame] = []
    columns = ["request_id", "rule_id", "rule_code", "start_minute", "end_minute", "status"]
    schema = "request_id long, reason string, rule_code string, rule_id long, start_minute int, end_minute int"

    def run(rows):
        asked = rows["request_id"].notna()
        out, left = _enable_in_order(rows[asked], rows[~asked])
        return pd.DataFrame([(*o, None, None, None, None) for o in out] + [(None, None, *e) for e in left],
                            columns=["request_id", "reason", "rule_code", "rule_id", "start_minute", "end_minute"]).astype(
            {"request_id": "Int64", "rule_id": "Int64", "start_minute": "Int32", "end_minute": "Int32"})

    for low, high in zip(bounds, bounds[1:]):
        asked = sound
        if low is not None:
            asked = asked.where(F.col("request_id") > low)
        if high is not None:
            asked = asked.where(F.col("request_id") <= high)
        if verdicts:
            done = union_all(verdicts).where("reason is null").join(sound, "request_id").select("rule_id", F.lit(True).alias("done"))
            asked = asked.join(done, "rule_id", "left").withColumn(
                "status", F.when(F.col("done"), "ENABLED").otherwise(F.col("status")))
        every = asked.select(*columns).unionByName(enabled.select(
            F.lit(None).cast("long").alias("request_id"), "rule_id", "rule_code", "start_minute", "end_minute",
            F.lit("ENABLED").alias("status")))
        found = stage(every.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(run, schema), "enabled-stretch")
        verdicts.append(found.where("request_id is not null").select("request_id", "reason"))
        enabled = found.where("request_id is null")
    return union_all(verdicts)


def enable_rules(rules: DataFrame, wanted: DataFrame, now: dt.datetime | str, hot_rows: int | None = None,
                 stretch_rows: int = STRETCH_ROWS) -> Enabling:
    """Enable the wanted versions (rule_id, request_id) in request order, each retiring the enabled ones of its code.

    Refused: unknown versions, versions that are no drafts at their turn, and drafts that share a minute with a
    rule of another code that is enabled at their turn. A refused request changes nothing; it may succeed when
    it is asked again later. Each request depends on the rules enabled before it, so stretches of requests
    follow each other, one task each.
    """
    known = rules.select("rule_id", "rule_code", "status", "start_minute", "end_minute")
    asked = stage(skew_join(wanted.select("rule_id", "request_id"), known, ["rule_id"], ["request_id"], "left", hot_rows),
                  "enable-requests")
    sound = asked.where(F.col("status") == "DRAFT")
    turns = _stretches(sound, known.where(F.col("status") == "ENABLED"), stretch_rows)
    unsound = F.when(F.col("status").isNull(), "rule_missing").when(F.col("status") != "DRAFT", "not_draft")
    judged = stage(asked.join(turns, "request_id", "left").withColumn("reason", F.coalesce(unsound, "reason")), "enable-judged")
    taken = judged.where(F.col("reason").isNull())
    takes = taken.select("rule_id", F.lit(True).alias("taken"))
    # Of several versions of a code that were enabled in turn the last one stays so.
    codes = taken.groupBy("rule_code").agg(F.max_by("rule_id", "request_id").alias("stays"))
    replaced = F.col("stays").isNotNull() & (F.col("stays") != F.col("rule_id"))
    retires = replaced & (F.coalesce("taken", F.lit(False)) | (F.col("status") == "ENABLED"))
    after = rules.join(takes, "rule_id", "left").join(codes, "rule_code", "left").withColumns({
        "enabled_time": F.when(F.col("taken"), ntz(now)).otherwise(F.col("enabled_time")),
        "retired_time": F.when(retires, ntz(now)).otherwise(F.col("retired_time")),
        "status": F.when(retires, "RETIRED").when(F.col("taken"), "ENABLED").otherwise(F.col("status")),
    }).select(*rules.columns)
    return Enabling(after, judged.where(F.col("reason").isNotNull()).select("request_id", "rule_id", "reason"))
