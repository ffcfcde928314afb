"""Registration of new entities: field rules, unique keys, parents, cross-field rules."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from netpen.functions import ring, times
from netpen.functions.numbers import survival_rate
from netpen.functions.text import is_blank
from netpen.operators.granting import grant_spans
from netpen.operators.hot import OrderedScan, hot_keys_of, is_hot, skew_join
from netpen.plans.rulecalc import RULE_TYPES
from netpen.session import stage

# Fixed values.
STATUSES = {
    "fish_batch": ["BREEDING", "MONITORING", "HARVESTED", "CLOSED"],
    "feeding_plan": ["ACTIVE", "SUSPENDED", "FINISHED"],
    "sensor": ["ONLINE", "OFFLINE", "MAINTENANCE"],
    "harvest_batch": ["PENDING", "ACCEPTED"],
    "ts_rule": ["DRAFT", "ENABLED", "RETIRED"],
}


class Registration(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


class FieldRule(NamedTuple):
    field: str
    code: str
    broken: Callable[[Column], Column]


def _text(field: str) -> FieldRule:
    return FieldRule(field, "required", is_blank)


def _given(field: str) -> FieldRule:
    return FieldRule(field, "required", lambda c: c.isNull())


def _positive(field: str) -> FieldRule:
    return FieldRule(field, "not_positive", lambda c: c <= 0)


def _not_negative(field: str) -> FieldRule:
    return FieldRule(field, "negative", lambda c: c < 0)


def _share(field: str) -> FieldRule:
    return FieldRule(field, "out_of_range", lambda c: (c < 0) | (c > 1))


FIELD_RULES: dict[str, list[FieldRule]] = {
    "fish_batch": [_text("batch_no"), _text("cage_no"), _text("species"), _given("fingerling_count"),
                   _positive("fingerling_count"), _not_negative("average_weight_g"), _given("stocking_time")],
    "feeding_plan": [_text("plan_no"), _given("batch_id"), _text("feed_type"), _given("daily_amount_kg"),
                     _positive("daily_amount_kg"), _given("feed_frequency"), _positive("feed_frequency"),
                     _given("start_date"), _given("end_date")],
    "sensor": [_text("sensor_no"), _text("cage_no"), _text("sensor_type"), _text("metric_unit"),
               _not_negative("depth_m"), _given("install_time")],
    "sensor_reading": [_text("reading_no"), _given("sensor_id"), _given("metric_value"),
                       _not_negative("metric_value"), _given("reading_time")],
    "feeding_record": [_text("record_no"), _given("batch_id"), _text("feed_type"), _given("amount_kg"),
                       _positive("amount_kg"), _given("feeding_time")],
    "survival_report": [_text("report_no"), _given("batch_id"), _given("alive_count"),
                        _not_negative("alive_count"), _share("survival_rate"), _given("report_time")],
    "harvest_batch": [_text("harvest_no"), _given("batch_id"), _given("harvest_count"),
                      _positive("harvest_count"), _given("total_weight_kg"), _positive("total_weight_kg"),
                      _given("harvest_time")],
    "cage_sea_area": [_text("cage_no"), _text("sea_area"), _text("time_zone")],
    "tide_session": [_text("tide_no"), _text("cage_no"), _given("start_at_utc"), _given("end_at_utc")],
    "feed_observation": [_text("obs_no"), _given("batch_id"), _given("observed_at_utc"),
                         _given("feed_amount_kg"), _positive("feed_amount_kg")],
    "ts_rule": [_text("rule_code"), _text("rule_type"), _given("start_minute"), _given("end_minute"),
                _given("coefficient"), _not_negative("coefficient")],
}
UNIQUE_KEY = {
    "fish_batch": "batch_no", "feeding_plan": "plan_no", "sensor": "sensor_no",
    "sensor_reading": "reading_no", "feeding_record": "record_no", "survival_report": "report_no",
    "harvest_batch": "harvest_no", "cage_sea_area": "cage_no", "tide_session": "tide_no",
    "feed_observation": "obs_no",
}


def field_errors(kind: str) -> Column:
    """Array of (field, code) of the broken field rules, in rule order."""
    found = [
        F.when(F.coalesce(rule.broken(F.col(rule.field)), F.lit(False)),
               F.struct(F.lit(rule.field).alias("field"), F.lit(rule.code).alias("code")))
        for rule in FIELD_RULES[kind]]
    return F.array_compact(F.array(*found))


def check_constraints(kind: str, df: DataFrame, row_id: str) -> DataFrame:
    """(row id, field, code): every broken field rule of every row, one row each."""
    return df.select(row_id, F.inline(field_errors(kind)))


def duplicate_keys(kind: str, df: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their count."""
    key = UNIQUE_KEY[kind]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_parents(children: DataFrame, parents: DataFrame, key: str, row_id: str,
                    hot_rows: int | None = None) -> DataFrame:
    """Child rows whose parent is not there."""
    known = parents.select(key).distinct()
    return skew_join(children.where(F.col(key).isNotNull()), known, [key], [row_id], "left_anti", hot_rows)


def _parent(tables: dict[str, DataFrame], name: str, key: str, prefix: str) -> DataFrame:
    """Parent table with prefixed columns, its key kept, and a marker."""
    parent = tables[name]
    return parent.select(F.col(key), F.lit(True).alias(f"{prefix}known"),
                         *[F.col(c).alias(f"{prefix}{c}") for c in parent.columns if c != key])


def _meets_stored(rows: DataFrame, stored: DataFrame, hot_rows: int | None) -> DataFrame:
    """``request_id`` of the new tides that meet a stored tide of their cage, found by one ordered scan.

    New tides stand at their end, stored ones at their start: those that begin before a new one ends are the rows
    before it, and one of them meets it if the latest of their ends is after its start.
    """
    # A stored tide without length meets what begins with it.
    reach = F.greatest("end_at_utc", F.col("start_at_utc") + F.expr("interval 1 microsecond"))
    known = stored.select("cage_no", F.col("start_at_utc").alias("__at"), reach.alias("__end"),
                          F.lit(True).alias("__old"), F.lit(-1).cast("bigint").alias("request_id"))
    every = rows.select("cage_no", F.col("end_at_utc").alias("__at"), F.col("start_at_utc").alias("__start"),
                        F.lit(False).alias("__old"), F.col("request_id").cast("bigint").alias("request_id")).unionByName(
        known, allowMissingColumns=True)
    scan = OrderedScan(every, ["cage_no"], ["__at", "__old", "request_id"], hot_rows=hot_rows)
    scan.carry(maximum={"__reached": F.col("__end")})
    return scan.rows().where(~F.col("__old") & (F.col("__start") < F.col("__reached"))).select("request_id")


def _grant_tides(rows: DataFrame, sound: Column, stored: DataFrame, hot_rows: int | None) -> DataFrame:
    """The rows with ``late``: key_exists or overlaps_tide, judged in request order.

    Only ``sound`` rows can be granted; a number counts as taken for every later request that asks for it.
    """
    asked = stage(rows.where(sound).select("request_id", "tide_no", "cage_no", "start_at_utc", "end_at_utc"), "sound-tides")
    met = stage(_meets_stored(asked, stored, hot_rows), "met-tides")
    judged = grant_spans(asked.join(met, "request_id", "left_anti"), "cage_no", "start_at_utc", "end_at_utc",
                         "request_id", "tide_no", hot_rows)
    verdicts = stage(judged.unionByName(met.withColumn("verdict", F.lit("meets_stored"))), "tide-verdicts")
    # One row per number that was granted.
    taken = asked.join(verdicts.where("verdict = 'granted'"), "request_id").select(
        "tide_no", F.col("request_id").alias("__holder"))
    met_any = F.col("verdict").isin("meets_granted", "meets_stored")
    return skew_join(rows.join(verdicts, "request_id", "left"), taken, ["tide_no"], ["request_id"], "left", hot_rows).withColumn(
        "late", F.when(F.col("__holder") < F.col("request_id"), "key_exists").when(met_any, "overlaps_tide")).drop(
        "verdict", "__holder")


def _with_taken(df: DataFrame, kind: str, stored: DataFrame, hot: list[int]) -> DataFrame:
    """``taken``: whether a stored row has the key."""
    used = stored.select(UNIQUE_KEY[kind]).distinct().withColumn("taken", F.lit(True))
    return skew_join(df, used, [UNIQUE_KEY[kind]], ["request_id"], hot=hot)


def _first_of_key(df: DataFrame, kind: str, stored: DataFrame, hot: list[int], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Judged rows, of which later open rows of a key are refused.

    The join with the stored keys and the choice of the first open row share one shuffle by key. Rows of hot
    keys, fewer than shuffle partitions, are spread instead and meet their few first rows by broadcast.
    """
    key = UNIQUE_KEY[kind]
    asked = lambda part, of: judge(_with_taken(part, kind, stored, of)).withColumn("__open", F.col("reason").isNull())
    late = lambda rows: rows.withColumn("reason", F.when(
        F.col("__open") & ~F.coalesce(F.col("request_id") == F.col("__least"), F.lit(False)), "key_exists"
    ).otherwise(F.col("reason"))).drop("__open", "__least")
    among = Window.partitionBy(key, "__open")
    if not hot:
        return late(asked(df, []).withColumn("__least", F.min("request_id").over(among)))
    cold = late(asked(df.where(~is_hot([key], hot)), []).withColumn("__least", F.min("request_id").over(among)))
    heavy = asked(df.where(is_hot([key], hot)), hot)
    firsts = heavy.where("__open").groupBy(key).agg(F.min("request_id").alias("__least"))
    return cold.unionByName(late(heavy.join(F.broadcast(firsts), key, "left").select(*heavy.columns, "__least")))


def _finish(df: DataFrame, reason: Column, kind: str, columns: list[str], derived: dict[str, Column],
            stored: DataFrame | None = None, hot: list[int] | None = None) -> Registration:
    """Split by reason; of accepted rows with one new key the first by ``request_id`` is kept.

    ``stored`` has the keys that are taken, unless the rows were held against them before.
    """
    errors = field_errors(kind)
    judge = lambda rows: rows.withColumn("reason", F.when(
        F.size(errors) > 0, F.concat_ws(":", F.get(errors, F.lit(0))["code"], F.get(errors, F.lit(0))["field"])
    ).otherwise(reason))
    # Tides of one number are told apart when they are granted.
    judged = judge(df) if stored is None else _first_of_key(df, kind, stored, hot, judge)
    accepted = judged.where(F.col("reason").isNull()).withColumns(derived).select(
        "request_id", *columns, *[c for c in derived if c not in columns])
    return Registration(accepted, judged.where(F.col("reason").isNotNull()).select("request_id", "reason"))


def register(kind: str, rows: DataFrame, tables: dict[str, DataFrame],
             hot_rows: int | None = None, zones: list[str] | None = None) -> Registration:
    """Judge new rows of one kind against the tables.

    ``rows`` has the entity's request fields and a ``request_id`` that tells rows apart and orders
    them. Accepted rows get what the entity derives: start status, the parent's cage, a default
    survival rate, the business date, the next rule version.
    """
    columns = [c for c in rows.columns if c != "request_id"]
    key, row = UNIQUE_KEY.get(kind), ["request_id"]
    parents = {"feeding_plan": ["batch_id"], "survival_report": ["batch_id"], "harvest_batch": ["batch_id"],
               "feed_observation": ["batch_id"], "feeding_record": ["batch_id", "plan_id"],
               "sensor_reading": ["sensor_id"], "tide_session": ["cage_no"]}.get(kind, [])
    groups = {c: [c] for c in parents + ([key] if key and key not in parents else [])}
    if groups:
        rows = stage(rows, f"new-{kind}")
    hot = hot_keys_of(rows, hot_rows, **groups) if groups else {}

    df = rows
    taken = F.coalesce("taken", F.lit(False))
    keyed = (tables[kind], hot[key]) if key else ()
    if "batch_id" in parents:
        df = skew_join(df, _parent(tables, "fish_batch", "batch_id", "batch_"), ["batch_id"], row, hot=hot["batch_id"])
    no_batch = F.col("batch_known").isNull() if "batch_id" in parents else None

    if kind == "fish_batch":
        return _finish(df, F.when(taken, "key_exists"), kind, columns, {"status": F.lit("BREEDING")}, *keyed)
    if kind == "sensor":
        return _finish(df, F.when(taken, "key_exists"), kind, columns, {"status": F.lit("ONLINE")}, *keyed)
    if kind == "feeding_plan":
        reason = (F.when(F.col("end_date") < F.col("start_date"), "end_before_start")
                  .when(no_batch, "batch_missing").when(taken, "key_exists"))
        return _finish(df, reason, kind, columns,
                       {"cage_no": F.col("batch_cage_no"), "status": F.lit("ACTIVE")}, *keyed)
    if kind == "survival_report":
        reason = (F.when(no_batch, "batch_missing")
                  .when(F.col("alive_count") > F.col("batch_fingerling_count"), "more_than_stocked")
                  .when(taken, "key_exists"))
        rate = survival_rate(F.col("survival_rate"), F.col("alive_count"), F.col("batch_fingerling_count"))
        return _finish(df, reason, kind, columns, {"cage_no": F.col("batch_cage_no"), "survival_rate": rate},
                       *keyed)
    if kind == "harvest_batch":
        reason = (F.when(no_batch, "batch_missing").when(F.col("batch_status") == "CLOSED", "batch_closed")
                  .when(F.col("harvest_count") > F.col("batch_fingerling_count"), "more_than_stocked")
                  .when(taken, "key_exists"))
        return _finish(df, reason, kind, columns,
                       {"cage_no": F.col("batch_cage_no"), "status": F.lit("PENDING")}, *keyed)
    if kind == "feed_observation":
        reason = F.when(no_batch, "batch_missing").when(taken, "key_exists")
        return _finish(df, reason, kind, columns, {"cage_no": F.col("batch_cage_no")}, *keyed)
    if kind == "feeding_record":
        plans = tables["feeding_plan"].select(
            "plan_id", F.col("batch_id").alias("plan_batch_id"), F.col("status").alias("plan_status"),
            F.col("cage_no").alias("plan_cage_no"))
        df = skew_join(df, plans, ["plan_id"], row, hot=hot["plan_id"])
        planned = F.col("plan_id").isNotNull()
        reason = (F.when(no_batch, "batch_missing").when(taken, "key_exists")
                  .when(planned & F.col("plan_batch_id").isNull(), "plan_missing")
                  .when(planned & (F.col("plan_batch_id") != F.col("batch_id")), "plan_of_other_batch")
                  .when(planned & (F.col("plan_status") != "ACTIVE"), "plan_not_active"))
        derived = {"cage_no": F.coalesce("plan_cage_no", "batch_cage_no"), "posted": F.lit(0)}
        if "migration_no" in tables["fish_batch"].columns:
            derived["migration_no"] = F.col("batch_migration_no")
        return _finish(df, reason, kind, columns, derived, *keyed)
    if kind == "sensor_reading":
        df = skew_join(df, _parent(tables, "sensor", "sensor_id", "sensor_"), ["sensor_id"], row,
                       hot=hot["sensor_id"])
        reason = (F.when(F.col("sensor_known").isNull(), "sensor_missing").when(taken, "key_exists")
                  .when(F.col("sensor_status").isin("OFFLINE", "MAINTENANCE"), "sensor_not_online"))
        return _finish(df, reason, kind, columns, {"cage_no": F.col("sensor_cage_no")}, *keyed)
    if kind == "cage_sea_area":
        known = times.known_zones(rows.sparkSession) if zones is None else zones
        reason = F.when(~times.is_zone(F.col("time_zone"), known), "bad_time_zone").when(taken, "key_exists")
        return _finish(df, reason, kind, columns, {}, *keyed)
    if kind == "tide_session":
        df = _with_taken(df, kind, *keyed)
        areas = tables["cage_sea_area"].select("cage_no", F.col("sea_area").alias("area"), F.col("time_zone").alias("zone"))
        df = skew_join(df, areas, ["cage_no"], row, hot=hot["cage_no"])
        reason = (F.when(taken, "key_exists")
                  .when(F.col("start_at_utc") >= F.col("end_at_utc"), "start_not_before_end")
                  .when(F.col("zone").isNull(), "no_sea_area"))
        sound = (F.size(field_errors(kind)) == 0) & reason.isNull()
        df = stage(_grant_tides(df, sound, tables["tide_session"], hot_rows), "judged-tides")
        taken_now = F.when(F.col("late") == "key_exists", F.col("late"))
        return _finish(df, F.coalesce(taken_now, reason, "late"), kind, columns, {
            "sea_area": F.col("area"), "time_zone": F.col("zone"),
            "business_date": times.business_date(F.col("start_at_utc"), F.col("zone"))})
    if kind == "ts_rule":
        reason = (F.when(~F.col("rule_type").isin(*RULE_TYPES), "bad_rule_type")
                  .when(~ring.is_valid(F.col("start_minute"), F.col("end_minute")), "bad_interval"))
        accepted, rejected = _finish(df, reason, kind, columns, {"status": F.lit("DRAFT")})
        return Registration(next_versions(accepted, tables["ts_rule"], hot_rows), rejected)
    raise ValueError(f"unknown kind {kind}")


def next_versions(drafts: DataFrame, rules: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Drafts numbered on from the highest stored version of their code."""
    newest = rules.groupBy("rule_code").agg(F.max("version_no").alias("__newest"))
    numbered = OrderedScan(drafts, ["rule_code"], ["request_id"], hot_rows=hot_rows).carry(count="__n").rows()
    joined = skew_join(numbered, newest, ["rule_code"], ["request_id"], "left", hot_rows)
    return joined.withColumn(
        "version_no", (F.coalesce("__newest", F.lit(0)) + F.col("__n") + 1).cast("int")).drop("__newest", "__n")
