"""Cage migration: checks, hand-off figures, snapshots, moved objects."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netpen.functions import text
from netpen.functions.times import ntz
from netpen.operators.hot import OrderedScan, hot_keys_of, skew_join
from netpen.operators.latest import recency
from netpen.plans.importer import ACTIVE, TERMINAL
from netpen.plans.overview import latest_survival, union_all
from netpen.session import stage

# Fixed values.
TRANSFER_TYPES = ["REPLACE", "TRANSFER"]
UNFINISHED = ["ACTIVE", "SUSPENDED"]
CLOCK_TOLERANCE_SECONDS = 1

# So many open requests are few enough for one task to take them one by one; more are settled in rounds first.
ONE_TASK_REQUESTS = 10_000

class Handoff(NamedTuple):
    events: DataFrame
    plans: DataFrame
    sensors: DataFrame
    moved_batches: DataFrame
    moved_plans: DataFrame
    moved_sensors: DataFrame
    chains: DataFrame
    rejected: DataFrame


def judge_requests(requests: DataFrame, batches: DataFrame, chains: DataFrame, events: DataFrame,
                   now: dt.datetime | str, hot_rows: int | None = None,
                   one_task: int = ONE_TASK_REQUESTS) -> DataFrame:
    """Requests with batch and chain state at their turn and ``reason``, null where the move goes ahead.

    Requests take their turns by ``request_id``: each is judged on the state that the granted ones before it
    left, so a batch may move several times, a cage that was left may be filled again, and a refused
    request blocks nobody.
    """
    state = batches.select(
        "batch_id", "batch_no", F.col("cage_no").alias("first_cage"), "status", "fingerling_count",
        F.coalesce("version", F.lit(0)).alias("first_version"), F.lit(True).alias("batch_known"))
    heads = chains.select("batch_id", "chain_no", "origin_cage_no", F.col("current_cage_no").alias("head_cage"),
                          F.col("current_seq").alias("first_seq"))
    state = state.join(heads, "batch_id", "left")
    asked = requests.withColumns({
        "target_cage_no": text.jtrim(F.col("target_cage_no")),
        "transfer_type": text.transfer_type(F.col("transfer_type")),
        "occurred_at": F.coalesce("occurred_at", ntz(now))})
    row = ["request_id"]
    hot = hot_keys_of(asked, hot_rows, batch=["batch_id"], cage=["target_cage_no"], number=["migration_no"])
    met = skew_join(asked, state, ["batch_id"], row, hot=hot["batch"])

    bad = lambda condition: F.coalesce(condition, F.lit(True))
    too_late = ntz(now) + F.expr(f"interval {CLOCK_TOLERANCE_SECONDS} second")
    unsound = (
        F.when(bad(~F.col("migration_no").rlike(text.MIGRATION_NO_PATTERN)), "bad_migration_no")
        .when(F.col("batch_id").isNull(), "batch_required")
        .when(bad(~text.is_key(F.col("target_cage_no"))), "bad_target_cage")
        .when(F.coalesce(F.col("operator_id") < 0, F.lit(False)), "bad_operator")
        .when(F.coalesce(~F.col("operator_name").rlike(text.OPERATOR_PATTERN), F.lit(False)), "bad_operator")
        .when(F.coalesce((F.col("expected_batch_version") < 0) | (F.col("expected_chain_seq") < 0),
                         F.lit(False)), "bad_expected_version")
        .when(F.col("occurred_at") > too_late, "in_the_future")
        .when(~F.col("transfer_type").isin(*TRANSFER_TYPES), "bad_transfer_type")
        .when(F.col("batch_known").isNull(), "batch_missing")
        .when(F.col("status").isin(*TERMINAL), "batch_terminal"))
    judged = stage(met.withColumn("unsound", unsound).drop("batch_known"), "handoff-requests")
    turns = _take_turns(judged.where("unsound is null"), batches, events, hot, one_task)
    return judged.join(turns, row, "left").select(
        *[c for c in judged.columns if c != "unsound"], "source_cage_no", "batch_version", "current_seq",
        F.coalesce("unsound", "refused").alias("reason"))


def _take_turns(sound: DataFrame, batches: DataFrame, events: DataFrame, hot: dict, one_task: int) -> DataFrame:
    """``request_id``, ``refused`` (null: granted) and the batch's cage, version and sequence at that turn.

    Settled in rounds. In a round a request waits while an earlier open one may still change what it depends
    on: its target (asked for earlier, or held by a batch that may leave earlier) or its number. What does not
    wait is settled, of each batch up to the first request that is granted or waits. The first open request
    of all never waits. A round is a few aggregates and joins over the open requests and their batches;
    rounds are as many as the longest chain of requests that depend on each other. Once at most ``one_task``
    requests are open, one task takes them one by one.
    """
    row = "request_id"
    left = stage(sound.select(
        row, "batch_id", "target_cage_no", "migration_no", "expected_batch_version", "expected_chain_seq"), "open-moves")
    # Batches that may move: where they are, their version and sequence. Their chain must begin where they are.
    movers = stage(sound.groupBy("batch_id").agg(
        F.first("first_cage").alias("cage"), F.first("first_version").alias("version"),
        F.coalesce(F.first("first_seq"), F.lit(0)).alias("seq"),
        F.coalesce(F.first("head_cage") == F.first("first_cage"), F.lit(True)).alias("linked")), "movers")
    targets = left.select(F.col("target_cage_no").alias("cage")).distinct()
    # Cages that are asked for and hold a batch nobody asks to move.
    full = batches.where(F.col("status").isin(*ACTIVE)).join(movers.select("batch_id"), "batch_id", "left_anti").select(
        F.col("cage_no").alias("cage")).join(targets, "cage", "left_semi").distinct()
    full = stage(full, "full-cages")
    used = events.select("migration_no").join(left.select("migration_no"), "migration_no", "left_semi").distinct()
    used = stage(used.withColumn("used_by", F.lit(None).cast("bigint")), "used-numbers")
    settled: list[DataFrame] = []
    while True:
        if left.count() <= one_task:
            return union_all([*settled, _one_by_one(left, movers, full, used)])
        judged = stage(_round(left, movers, full, used, hot), "judged-moves")
        done = judged.where("settled")
        settled.append(done.select(row, "refused", F.col("cage").alias("source_cage_no"),
                                   F.col("version").alias("batch_version"), F.col("seq").alias("current_seq")))
        still = stage(judged.where("not settled").select(*left.columns), "open-moves")
        if still.isEmpty():
            return union_all(settled)
        granted = done.where("refused is null")
        moved = granted.select("batch_id", F.col("target_cage_no").alias("to"))
        now_at = movers.join(moved, "batch_id", "left").select(
            "batch_id", F.coalesce("to", "cage").alias("cage"), (F.col("version") + F.col("to").isNotNull().cast("int")).alias("version"),
            (F.col("seq") + F.col("to").isNotNull().cast("int")).alias("seq"), "linked")
        now_at = stage(now_at, "movers")
        asked_for = still.select("batch_id").distinct()
        stays = now_at.join(asked_for, "batch_id", "left_anti").select("cage")
        full = stage(full.unionByName(stays).distinct(), "full-cages")
        used = stage(used.unionByName(granted.select("migration_no", F.col(row).alias("used_by"))), "used-numbers")
        movers = stage(now_at.join(asked_for, "batch_id", "left_semi"), "movers")
        left = still


def _one_by_one(left: DataFrame, movers: DataFrame, full: DataFrame, used: DataFrame) -> DataFrame:
    """The last few requests in one task, each on the state that the ones before it left."""
    rows = left.join(movers, "batch_id", "left").join(
        full.select(F.col("cage").alias("target_cage_no"), F.lit(True).alias("full")), "target_cage_no", "left").join(
        used.select("migration_no", F.lit(True).alias("used")).distinct(), "migration_no", "left")

    def differs(expected, actual) -> bool:
        return expected is not None and expected == expected and expected != actual

    def run(rows):
        rows = rows.sort_values("request_id")
        numbers = set(rows.loc[rows["used"].notna(), "migration_no"])
        filled = set(rows.loc[rows["full"].notna(), "target_cage_no"])
        at, standing, out = {}, {}, []
        for r in rows.itertuples():
            if r.batch_id not in at:
                at[r.batch_id] = r.cage, r.version, r.seq
                standing[r.cage] = standing.get(r.cage, 0) + 1
        for r in rows.itertuples():
            cage, version, seq = at[r.batch_id]
            reason = ("same_cage" if r.target_cage_no == cage else
                      "target_occupied" if r.target_cage_no in filled or standing.get(r.target_cage_no) else
                      "migration_no_exists" if r.migration_no in numbers else
                      "batch_version_differs" if differs(r.expected_batch_version, version) else
                      "chain_head_differs" if not r.linked else
                      "chain_seq_differs" if differs(r.expected_chain_seq, seq) else None)
            out.append((r.request_id, reason, cage, version, seq))
            if reason is None:
                at[r.batch_id] = r.target_cage_no, version + 1, seq + 1
                standing[cage] -= 1
                standing[r.target_cage_no] = standing.get(r.target_cage_no, 0) + 1
                numbers.add(r.migration_no)
        return pd.DataFrame(out, columns=["request_id", "refused", "source_cage_no", "batch_version", "current_seq"])

    return rows.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(
        run, "request_id long, refused string, source_cage_no string, batch_version int, current_seq int")


def _round(left: DataFrame, movers: DataFrame, full: DataFrame, used: DataFrame, hot: dict) -> DataFrame:
    """Open requests with their batch's state, ``refused`` and ``settled``."""
    row = "request_id"
    first = left.groupBy("batch_id").agg(F.min(row).alias("first"))
    there = movers.join(first, "batch_id").groupBy(F.col("cage").alias("target_cage_no")).agg(
        # A target is held up to the turn at which the last of its batches may leave it; from the first turn on it may change.
        F.max("first").alias("held_until"), F.min("first").alias("left_from"))
    wanted = left.groupBy("target_cage_no").agg(F.min(row).alias("wanted_from"))
    numbers = left.groupBy("migration_no").agg(F.min(row).alias("asked_from"))
    met = skew_join(left, movers, ["batch_id"], [row], "left", hot=hot["batch"])
    for side in (there, wanted, full.select(F.col("cage").alias("target_cage_no"), F.lit(True).alias("full"))):
        met = skew_join(met, side, ["target_cage_no"], [row], "left", hot=hot["cage"])
    for side in (numbers, used.select("migration_no", F.lit(True).alias("used"))):
        met = skew_join(met, side, ["migration_no"], [row], "left", hot=hot["number"])
    # Who asked earlier for the cage that a request leaves must find it as it was.
    met = met.join(wanted.select(F.col("target_cage_no").alias("cage"), F.col("wanted_from").alias("source_from")), "cage", "left")
    at = F.col(row)
    differs = lambda expected, actual: F.coalesce(F.col(expected) != F.col(actual), F.lit(False))
    answer = (
        F.when(F.col("target_cage_no") == F.col("cage"), "same_cage")
        .when(F.col("full") | (at < F.col("held_until")), "target_occupied")
        .when((F.col("wanted_from") < at) | (F.col("left_from") <= at) | (F.col("source_from") < at), "waits")
        .when(F.col("used"), "migration_no_exists")
        .when(F.col("asked_from") < at, "waits")
        .when(differs("expected_batch_version", "version"), "batch_version_differs")
        .when(~F.col("linked"), "chain_head_differs")
        .when(differs("expected_chain_seq", "seq"), "chain_seq_differs"))
    met = met.withColumn("answer", answer)
    # The first of the batch that is not refused: later ones depend on it.
    turn = met.groupBy("batch_id").agg(F.min(F.when(F.col("answer").isNull() | (F.col("answer") == "waits"), at)).alias("turn"))
    met = skew_join(met, turn, ["batch_id"], [row], "left", hot=hot["batch"])
    settled = F.coalesce(at < F.col("turn"), F.lit(True)) | ((at == F.col("turn")) & F.col("answer").isNull())
    return met.select(*left.columns, "cage", "version", "seq", F.col("answer").alias("refused"), settled.alias("settled"))


def feed_totals(records: DataFrame) -> DataFrame:
    posted = F.col("posted") == 1
    zero = F.lit(0).cast("decimal(18,2)")
    money = lambda c: F.coalesce(F.sum(c).cast("decimal(18,2)"), zero)
    return records.groupBy("batch_id").agg(
        money(F.when(posted, F.col("amount_kg"))).alias("posted_kg"),
        money(F.when(~posted, F.col("amount_kg"))).alias("unposted_kg"),
        F.count(F.lit(1)).alias("record_count"), F.count_if(posted).alias("posted_count"))


def _newest_and_count(readings: DataFrame) -> DataFrame:
    """Per sensor the newest reading and the number of readings, in one aggregate."""
    order = recency(F.col("reading_time"), F.col("reading_id"))
    return readings.withColumn("__recency", order).groupBy("sensor_id").agg(
        F.max_by("metric_value", "__recency").alias("metric_value"),
        F.max_by("reading_time", "__recency").alias("reading_time"), F.count(F.lit(1)).alias("reading_count"))


def _walks(winners: DataFrame, sensors: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(sensor_id, request_id, hop): the moves that take each ONLINE sensor along, in order.

    The first move away from a sensor's cage takes it, then the first later move away from where that led.
    The next move of every move is found by one ordered scan of departures and arrivals per cage; the
    walks then follow it, all sensors a hop a round.
    """
    legs = winners.select("request_id", F.explode(F.array(
        F.struct(F.col("source_cage_no").alias("cage"), F.lit(True).alias("leaves")),
        F.struct(F.col("target_cage_no").alias("cage"), F.lit(False).alias("leaves")))).alias("leg")).select("request_id", "leg.*")
    scan = OrderedScan(legs.withColumn("__from_end", -F.col("request_id")), ["cage"], ["__from_end"], hot_rows=hot_rows)
    following = stage(scan.carry(last={"next_id": F.when(F.col("leaves"), F.col("request_id"))}).rows().where(
        ~F.col("leaves") & F.col("next_id").isNotNull()).select("request_id", "next_id"), "next-moves")
    starts = winners.groupBy(F.col("source_cage_no").alias("cage_no")).agg(F.min("request_id").alias("request_id"))
    online = sensors.where(F.col("status") == "ONLINE").select("sensor_id", "cage_no")
    at = stage(skew_join(online, starts, ["cage_no"], ["sensor_id"], "inner", hot_rows).select(
        "sensor_id", "request_id", F.lit(0).alias("hop")), "sensor-moves")
    hops = [at]
    while not at.isEmpty():
        at = stage(at.join(following, "request_id").select(
            "sensor_id", F.col("next_id").alias("request_id"), (F.col("hop") + 1).alias("hop")), "sensor-moves")
        hops.append(at)
    return union_all(hops)


def sensors_to_hand_over(winners: DataFrame, sensors: DataFrame, readings: DataFrame,
                         hot_rows: int | None = None) -> DataFrame:
    """Per move the sensors of its source cage at its turn: ONLINE ones move along, the others stay."""
    moves = winners.select("request_id", F.col("source_cage_no").alias("cage_no"), "migration_no", "target_cage_no")
    staying = skew_join(sensors.where(F.coalesce(F.col("status") != "ONLINE", F.lit(True))), moves, ["cage_no"],
                        ["sensor_id"], "inner", hot_rows).withColumn("hop", F.lit(0))
    going = _walks(winners, sensors, hot_rows).join(moves.drop("cage_no"), "request_id").join(sensors, "sensor_id")
    there = stage(going.select(*staying.columns).unionByName(staying), "handed-sensors")
    # Readings of these sensors only.
    newest = _newest_and_count(readings.join(there.select("sensor_id").distinct(), "sensor_id", "left_semi"))
    return there.join(newest, "sensor_id", "left").select(
        "migration_no", "sensor_id", "sensor_no", "sensor_type", "metric_unit", "status",
        (F.coalesce("version", F.lit(0)) + F.col("hop")).cast("int").alias("version"),
        F.col("metric_value").alias("latest_value"), F.col("reading_time").alias("latest_reading_at"),
        F.coalesce("reading_count", F.lit(0).cast("bigint")).alias("reading_count"),
        (F.col("status") == "ONLINE").cast("int").alias("moved"), "target_cage_no")


def plans_to_hand_over(winners: DataFrame, plans: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Per move the batch's unfinished plans; each move before raised their version."""
    open_plans = plans.where(F.col("status").isin(*UNFINISHED))
    moves = winners.select("batch_id", "migration_no", "target_cage_no",
                           (F.col("batch_version") - F.col("first_version")).alias("hop"))
    return skew_join(open_plans, moves, ["batch_id"], ["plan_id"], "inner", hot_rows).select(
        "migration_no", "plan_id", "plan_no", "status", "daily_amount_kg",
        (F.coalesce("version", F.lit(0)) + F.col("hop")).cast("int").alias("version"), "target_cage_no")


def handoff_figures(winners: DataFrame, records: DataFrame, reports: DataFrame, plans: DataFrame,
                    sensors: DataFrame) -> DataFrame:
    """Per migration the figures that both cages must agree on."""
    moved = winners.select("batch_id").distinct()
    records = records.join(moved, "batch_id", "left_semi")
    newest = latest_survival(reports.join(moved, "batch_id", "left_semi")).select("batch_id", "alive_count", "survival_rate", "report_time",
                                             F.lit(True).alias("reported"))
    plan_counts = plans.groupBy("migration_no").agg(F.count(F.lit(1)).alias("plan_count"))
    sensor_counts = sensors.groupBy("migration_no").agg(
        F.sum("moved").alias("moved_count"), F.sum(1 - F.col("moved")).alias("retained_count"))
    zero, none = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(18,2)")
    return (
        winners.join(feed_totals(records), "batch_id", "left").join(newest, "batch_id", "left")
        .join(plan_counts, "migration_no", "left").join(sensor_counts, "migration_no", "left")
        .select(
            "migration_no", "batch_id", "batch_no", "batch_version",
            F.coalesce("chain_no", F.concat(F.lit("CHAIN-"), "batch_no")).alias("chain_no"),
            F.coalesce("origin_cage_no", "first_cage").alias("origin_cage_no"),
            (F.col("current_seq") + 1).cast("int").alias("seq_no"),
            "transfer_type", "source_cage_no", "target_cage_no", "occurred_at", "operator_id",
            "operator_name", "remark",
            F.when(F.col("reported"), F.col("alive_count")).otherwise(F.col("fingerling_count"))
            .alias("fish_estimate_count"),
            F.when(F.col("reported"), "LATEST_SURVIVAL").otherwise("FINGERLING").alias("fish_estimate_basis"),
            F.coalesce("posted_kg", none).alias("cumulative_feed_kg"),
            F.coalesce("unposted_kg", none).alias("cumulative_unposted_kg"),
            F.coalesce("record_count", zero).alias("feeding_record_count"),
            F.coalesce("posted_count", zero).alias("posted_record_count"),
            F.col("survival_rate").alias("latest_survival_rate"),
            F.col("report_time").alias("latest_survival_at"),
            F.coalesce("plan_count", zero).alias("feeding_plan_count"),
            F.coalesce("moved_count", zero).alias("sensor_count"),
            F.coalesce("retained_count", zero).alias("retained_sensor_count"))
    )


def encode_snapshot(figures: DataFrame) -> DataFrame:
    """(migration_no, snapshot_json): the hand-off document, figures and counts of both sides.

    The plans and sensors that it counts are rows of the hand-off's own tables, however many.
    """
    iso = text.iso_seconds

    def side(cage: str, retained: Column) -> Column:
        return F.struct(
            F.col(cage).alias("cageNo"), F.col("fish_estimate_count").alias("fishEstimateCount"),
            F.col("cumulative_feed_kg").alias("cumulativePostedFeedKg"),
            F.col("cumulative_unposted_kg").alias("cumulativeUnpostedFeedKg"),
            F.col("feeding_record_count").alias("feedingRecordCount"),
            F.col("posted_record_count").alias("postedRecordCount"),
            F.col("latest_survival_rate").alias("latestSurvivalRate"),
            iso(F.col("latest_survival_at")).alias("latestSurvivalAt"),
            F.col("feeding_plan_count").alias("feedingPlanCount"),
            F.col("sensor_count").alias("movedSensorCount"), retained.alias("retainedSensorCount"))

    document = F.struct(
        F.col("migration_no").alias("migrationNo"), F.col("chain_no").alias("chainNo"),
        F.col("seq_no").alias("seqNo"), F.col("transfer_type").alias("transferType"),
        F.col("batch_id").alias("batchId"), F.col("batch_no").alias("batchNo"),
        iso(F.col("occurred_at")).alias("occurredAt"),
        F.col("fish_estimate_basis").alias("fishEstimateBasis"),
        side("source_cage_no", F.col("retained_sensor_count")).alias("source"),
        side("target_cage_no", F.lit(0).cast("bigint")).alias("target"))
    return figures.select("migration_no", F.to_json(document).alias("snapshot_json"))


def migration_handoff(requests: DataFrame, batches: DataFrame, plans: DataFrame, sensors: DataFrame,
                      readings: DataFrame, records: DataFrame, reports: DataFrame, chains: DataFrame,
                      events: DataFrame, now: dt.datetime | str,
                      hot_rows: int | None = None, one_task: int = ONE_TASK_REQUESTS) -> Handoff:
    """Hand-off of all requests: events to append, objects that move, refused requests."""
    judged = stage(judge_requests(requests, batches, chains, events, now, hot_rows, one_task), "handoff-judged")
    winners = judged.where(F.col("reason").isNull())
    # Of several moves of one object in a run the last one tells where it stands.
    last = lambda rows, key, by, values: rows.groupBy(key).agg(*[F.max_by(v, by).alias(v) for v in values])
    plan_rows = stage(plans_to_hand_over(winners, plans, hot_rows), "handoff-plans")
    sensor_rows = stage(sensors_to_hand_over(winners, sensors, readings, hot_rows), "handoff-sensors")
    figures = handoff_figures(winners, records, reports, plan_rows, sensor_rows)
    documents = encode_snapshot(figures)
    moved = lambda rows, key: last(rows.select(
        key, F.col("target_cage_no").alias("cage_no"), (F.col("version") + 1).alias("version"), "migration_no"),
        key, "version", ["cage_no", "version", "migration_no"])
    return Handoff(
        events=figures.join(documents, "migration_no"),
        plans=plan_rows, sensors=sensor_rows,
        moved_batches=last(winners.select(
            "batch_id", F.col("target_cage_no").alias("cage_no"),
            (F.col("batch_version") + 1).alias("version"), F.col("occurred_at").alias("migrated_at"),
            "migration_no"), "batch_id", "version", ["cage_no", "version", "migrated_at", "migration_no"]),
        moved_plans=moved(plan_rows, "plan_id"),
        moved_sensors=moved(sensor_rows.where(F.col("moved") == 1), "sensor_id"),
        chains=last(figures.select(
            "chain_no", "batch_id", "origin_cage_no", F.col("target_cage_no").alias("current_cage_no"),
            F.col("seq_no").alias("current_seq")), "chain_no", "current_seq",
            ["batch_id", "origin_cage_no", "current_cage_no", "current_seq"]),
        rejected=judged.where(F.col("reason").isNotNull()).select("request_id", "migration_no", "reason"))
