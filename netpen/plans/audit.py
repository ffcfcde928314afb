"""Audit of migration chains, histories by cage, and facts placed on the migration timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netpen.operators.hot import OrderedScan, skew_join
from netpen.operators.latest import compute_once
from netpen.session import stage
from netpen.sources.snapshots import decode_sides

# Fixed values.
CHECKS = ["SEQ_CONTINUOUS", "CAGE_LINKED", "TIME_ORDERED", "HANDOFF_EQUAL", "FEED_MONOTONIC",
          "SNAPSHOT_READABLE"]
SEQ_CHUNK = 10_000


def _handoff_flags(events: DataFrame) -> DataFrame:
    """``readable`` and ``handed_over``: both sides of the snapshot are there and agree."""
    snap = F.col("__snap")
    source, target = snap["source"], snap["target"]
    # Older documents list the sensors instead of counting them.
    listed = lambda side: F.when(side["movedSensors"].isNull(), 0).otherwise(F.size(side["movedSensors"]))
    moved = lambda side: F.coalesce(side["movedSensorCount"], listed(side))
    same = lambda field: source[field].eqNullSafe(target[field])
    readable = F.coalesce(source.isNotNull() & target.isNotNull(), F.lit(False))
    agree = (same("fishEstimateCount") & same("cumulativePostedFeedKg") & same("latestSurvivalRate")
             & same("feedingPlanCount") & (moved(source) == moved(target)))
    decoded = compute_once(events, decode_sides(F.col("snapshot_json")).alias("__snap")).drop("snapshot_json")
    return decoded.withColumns({
        "readable": readable, "handed_over": readable & F.coalesce(agree, F.lit(False))}).drop("__snap")


def handoff_mismatches(events: DataFrame) -> DataFrame:
    """Events whose two snapshot sides differ, or cannot be read."""
    return _handoff_flags(events).where(~F.col("handed_over")).select(
        "chain_no", "migration_no", "seq_no", F.col("readable").cast("int").alias("readable"))


def _compared(events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each event with what holds between it and the one before it, from a single ordered scan."""
    before = F.struct("seq_no", "migration_no", "target_cage_no", "occurred_at", "cumulative_feed_kg")
    scan = OrderedScan(_handoff_flags(events), ["chain_no"], ["seq_no", "migration_no"],
                       F.floor(F.col("seq_no") / SEQ_CHUNK), hot_rows)
    prev = F.col("prev")
    first = prev.isNull()
    return scan.carry(last={"prev": before}).rows().withColumns({
        "next_number": F.when(first, F.col("seq_no") == 1).otherwise(F.col("seq_no") == prev["seq_no"] + 1),
        "linked": first | (prev["target_cage_no"] == F.col("source_cage_no")),
        "later": first | (F.col("occurred_at") > prev["occurred_at"]),
        "not_less": F.coalesce(F.col("cumulative_feed_kg") >= prev["cumulative_feed_kg"], F.lit(True)),
    })


def chain_breaks(chains: DataFrame, events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The events at which a chain fails a check, one row per chain, check and event, with the event before it.

    Of each unbroken run of such events the first carries ``run_length``, how many follow each other without a
    sound one between; the others have null. Faults of a chain's ends, which no event has, are in ``audit_chains``.
    """
    known = chains.select("chain_no").distinct()
    flags = {"SEQ_CONTINUOUS": "next_number", "CAGE_LINKED": "linked", "TIME_ORDERED": "later",
             "HANDOFF_EQUAL": "handed_over", "FEED_MONOTONIC": "not_less", "SNAPSHOT_READABLE": "readable"}
    compared = skew_join(_compared(events, hot_rows), known, ["chain_no"], ["migration_no"], "left_semi", hot_rows)
    checked = stage(compared.select(
        "chain_no", "seq_no", "migration_no", F.col("prev")["migration_no"].alias("previous_no"),
        *[F.coalesce(F.col(flag), F.lit(True)).alias(f"sound_{name}") for name, flag in flags.items()]), "checked-events")
    # A run is told by the last sound event before it, the same for all its members. All checks go in one scan;
    # only the broken ones become rows of their own.
    scan = OrderedScan(checked, ["chain_no"], ["seq_no", "migration_no"], F.floor(F.col("seq_no") / SEQ_CHUNK), hot_rows)
    here = F.struct("seq_no", "migration_no")
    scanned = scan.carry(last={f"last_{name}": F.when(F.col(f"sound_{name}"), here) for name in flags}).rows()
    of_check = [F.when(~F.col(f"sound_{name}"), F.struct(F.lit(name).alias("check_name"), F.col(f"last_{name}").alias("last_sound")))
                for name in flags]
    rows = stage(scanned.select("chain_no", "seq_no", "migration_no", "previous_no",
                                F.inline(F.array_compact(F.array(*of_check)))), "broken-checks")
    runs = rows.groupBy("chain_no", "check_name", "last_sound").agg(
        F.count(F.lit(1)).alias("run_length"), F.min(F.struct("seq_no", "migration_no")).alias("begins"))
    runs = runs.select("chain_no", "check_name", "run_length", "begins.*")
    return rows.join(runs, ["chain_no", "check_name", "seq_no", "migration_no"], "left").select(
        "chain_no", "check_name", "seq_no", "migration_no", "previous_no", "run_length")


def audit_wide(chains: DataFrame, events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per chain with one 0/1 column per check.

    Each event is compared with the one before it in a single ordered scan; the rest is one
    aggregate per chain.
    """
    holds = lambda condition: F.coalesce(condition, F.lit(True))
    flagged = _compared(events, hot_rows)
    position = F.struct("seq_no", "migration_no")
    sums = flagged.groupBy("chain_no").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("source_cage_no", position).alias("first_source"),
        F.max_by("target_cage_no", position).alias("last_target"),
        *[F.bool_and(c).alias(c) for c in
          ("next_number", "linked", "later", "not_less", "handed_over", "readable")])
    n = F.coalesce("event_count", F.lit(0).cast("bigint"))
    ends_meet = ((F.col("origin_cage_no") == F.col("first_source"))
                 & (F.col("current_cage_no") == F.col("last_target")))
    flag = lambda condition, none: F.coalesce(condition, F.lit(none)).cast("int")
    return chains.join(sums, "chain_no", "left").select(
        "chain_no", "batch_id", n.alias("event_count"),
        flag((n == F.col("current_seq")) & holds(F.col("next_number")), False).alias("SEQ_CONTINUOUS"),
        flag((n > 0) & ends_meet & F.col("linked"), False).alias("CAGE_LINKED"),
        flag(F.col("later"), True).alias("TIME_ORDERED"),
        flag(F.col("handed_over"), True).alias("HANDOFF_EQUAL"),
        flag(F.col("not_less"), True).alias("FEED_MONOTONIC"),
        flag(F.col("readable"), True).alias("SNAPSHOT_READABLE"))


def audit_chains(chains: DataFrame, events: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per (chain, check)."""
    detail: dict[str, Column] = {
        "SEQ_CONTINUOUS": F.concat(F.lit("events="), F.col("event_count").cast("string"))}
    checks = F.array(*[
        F.struct(F.lit(c).alias("check_name"), F.col(c).alias("passed"),
                 detail.get(c, F.lit(None).cast("string")).alias("detail")) for c in CHECKS])
    return audit_wide(chains, events, hot_rows).select(
        "chain_no", "batch_id", F.inline(checks))


def chains_by_cage(chains: DataFrame, events: DataFrame) -> DataFrame:
    """(cage_no, chain_no) for every cage a chain begins in, stands in or passes through."""
    ends = chains.select("chain_no", F.explode(F.array("origin_cage_no", "current_cage_no")).alias("cage_no"))
    hops = events.select("chain_no", F.explode(F.array("source_cage_no", "target_cage_no")).alias("cage_no"))
    return ends.unionByName(hops).distinct().select("cage_no", "chain_no")


def history_by_cage(chains: DataFrame, events: DataFrame, cage_no: str) -> DataFrame:
    """Audit rows of every chain that touched one cage."""
    touched = chains_by_cage(chains, events).where(F.col("cage_no") == cage_no).select("chain_no")
    return audit_chains(chains.join(touched, "chain_no", "left_semi"),
                        events.join(touched, "chain_no", "left_semi"))


def place_on_timeline(facts: DataFrame, time: str, row_id: str, batches: DataFrame,
                      events: DataFrame, by: str = "event_time",
                      hot_rows: int | None = None) -> DataFrame:
    """Facts of a batch with the cage and migration of their time segment.

    A fact from the moment of a move on belongs to the new cage; one before every move belongs to
    the first source cage, or to the batch's cage where it never moved. With ``by="stored"`` a
    migration number already on the fact is kept.
    """
    moves = events.select(
        "batch_id", F.col("occurred_at").alias("__at"), F.lit(0).alias("__kind"),
        F.col("seq_no").cast("bigint").alias("__tie"),
        F.struct("migration_no", "target_cage_no").alias("__move"))
    rows = facts.withColumns({
        "__at": F.col(time), "__kind": F.lit(1), "__tie": F.col(row_id).cast("bigint")})
    scan = OrderedScan(rows.unionByName(moves, allowMissingColumns=True), ["batch_id"],
                       ["__at", "__kind", "__tie"], hot_rows=hot_rows)
    placed = scan.carry(last={"__segment": F.col("__move")}).rows().where(F.col("__kind") == 1)
    start = events.groupBy("batch_id").agg(
        F.min_by("source_cage_no", F.struct("seq_no", "migration_no")).alias("__origin"))
    homes = batches.select("batch_id", F.col("cage_no").alias("__home")).join(start, "batch_id", "left").select(
        "batch_id", F.coalesce("__origin", "__home").alias("__before"))
    placed = skew_join(placed, homes, ["batch_id"], ["__tie"], "left", hot_rows)
    migration = F.col("__segment")["migration_no"]
    if by == "stored":
        migration = F.coalesce("migration_no", migration)
    return placed.withColumns({
        "segment_cage_no": F.coalesce(F.col("__segment")["target_cage_no"], F.col("__before")),
        "segment_migration_no": migration,
    }).drop("__at", "__kind", "__tie", "__move", "__segment", "__before")
