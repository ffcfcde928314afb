"""Field validation of observation lines: the first error in field order wins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from netpen.functions import text
from netpen.functions.numbers import parse_decimal
from netpen.functions.times import FUTURE_TOLERANCE, ntz, parse_time
from netpen.operators.latest import compute_once

# Fixed values.
MAX_FEED_KG = "99999.99"
MAX_SENSOR_VALUE = "99999999.9999"
FEED_SCALE, RATE_SCALE, SENSOR_SCALE = 2, 4, 4
MAX_UNIT_LENGTH = 16
MAX_RAW_VALUE, MAX_RAW_LINE = 255, 1000

_ERROR_TYPE = "struct<field:string,raw:string,reason:string>"


def error(field: str | Column, raw: Column | None, reason: str | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(field).alias("field"),
        (F.lit(None).cast("string") if raw is None else raw).alias("raw"),
        as_col(reason).alias("reason")).cast(_ERROR_TYPE)


def _key_error(field: str, raw: Column, value: Column) -> Column:
    return F.when(value.isNull(), error(field, raw, "required")).when(
        ~text.is_key(value), error(field, raw, "bad_key"))


def _width_error(fields: Column) -> Column:
    width, names = len(text.OBS_HEADER), F.array(*[F.lit(n) for n in text.OBS_HEADER])
    first_missing = F.get(names, F.size(fields))
    return F.when(F.size(fields) < width, error(first_missing, None, "column_count")).when(
        F.size(fields) > width, error("_row", None, "column_count"))


def _number_error(field: str, raw: Column, number: Column, low: Column, low_reason: str,
                  high: str) -> Column:
    value, problem = number["value"], number["problem"]
    return (
        F.when(problem.isin("not_a_number", "too_many_decimals"), error(field, raw, problem))
        .when(number["negative"] | low, error(field, raw, low_reason))
        .when((problem == "out_of_range") | (value > F.lit(high).cast("decimal(38,18)")),
              error(field, raw, "out_of_range"))
    )


def parse_rows(lines: DataFrame) -> DataFrame:
    """Split each line and parse its typed parts; nothing is judged yet."""
    # The line first: the fields name it several times, and it may be an expression itself.
    line = compute_once(lines.withColumnRenamed("raw_line", "__line"), F.col("__line").alias("raw_line")).drop("__line")
    fields = compute_once(line, text.csv_fields(F.col("raw_line")).alias("fields"))
    names = ["voyage_no", "cage_no", "__time_text", "__feed_text", "__rate_text", "__value_text",
             "sensor_unit", "source_device"]
    part = lambda i: F.get("fields", F.lit(i))
    texts = compute_once(fields, *[F.when(F.length(part(i)) > 0, part(i)).alias(n) for i, n in enumerate(names)])
    return compute_once(
        texts,
        parse_time(F.col("__time_text")).alias("observed_at"),
        parse_decimal(F.col("__feed_text"), FEED_SCALE).alias("__feed"),
        parse_decimal(F.col("__rate_text"), RATE_SCALE).alias("__rate"),
        parse_decimal(F.col("__value_text"), SENSOR_SCALE).alias("__value"))


def validate_rows(lines: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Typed columns plus ``err`` (field, raw, reason), null for a sound row.

    Sound rows have every value in its storage type and a business key; the others keep the key
    text that could be read.
    """
    raw = lambda i: F.get("fields", F.lit(i))
    device, unit = F.col("source_device"), F.col("sensor_unit")
    feed, rate, value = F.col("__feed"), F.col("__rate"), F.col("__value")
    latest_allowed = ntz(now) + F.expr(f"interval {int(FUTURE_TOLERANCE.total_seconds())} seconds")
    time_error = (
        F.when(F.col("__time_text").isNull(), error("observed_at", raw(2), "required"))
        .when(F.col("observed_at").isNull(), error("observed_at", raw(2), "bad_time"))
        .when(F.col("observed_at") > latest_allowed, error("observed_at", raw(2), "future_time")))
    sensor_error = F.when(
        F.col("__value_text").isNotNull(),
        F.when(device.isNull(), error("source_device", None, "required"))
        .when(~text.is_key(device), error("source_device", device, "bad_key"))
        .when(unit.isNull(), error("sensor_unit", None, "required"))
        .when(F.length(unit) > MAX_UNIT_LENGTH, error("sensor_unit", unit, "too_long")))
    measures = [F.col(c) for c in ("__feed_text", "__rate_text", "__value_text")]
    nothing = measures[0].isNull() & measures[1].isNull() & measures[2].isNull()
    err = F.coalesce(
        _width_error(F.col("fields")),
        _key_error("voyage_no", raw(0), F.col("voyage_no")),
        _key_error("cage_no", raw(1), F.col("cage_no")),
        time_error,
        _number_error("feed_amount_kg", raw(3), feed, feed["value"] <= 0, "not_positive", MAX_FEED_KG),
        _number_error("survival_rate", raw(4), rate, rate["value"] < 0, "out_of_range", "1"),
        _number_error("sensor_value", raw(5), value, value["value"] < 0, "negative", MAX_SENSOR_VALUE),
        sensor_error,
        F.when(nothing, error("_row", None, "no_measure")))

    judged = compute_once(parse_rows(lines), err.alias("err"))
    sound = F.col("err").isNull()
    has_value = sound & F.col("__value_text").isNotNull()
    keep = lambda name, kind: F.when(sound, F.col(name)["value"].cast(kind))
    key = F.when(sound, text.business_key(
        F.col("voyage_no"), F.col("cage_no"), F.col("observed_at"))
    ).otherwise(text.best_effort_key(F.col("fields")))
    result = F.struct(
        "voyage_no", "cage_no", "observed_at",
        keep("__feed", "decimal(10,2)").alias("feed_amount_kg"),
        keep("__rate", "decimal(7,4)").alias("survival_rate"),
        keep("__value", "decimal(12,4)").alias("sensor_value"),
        F.when(has_value, unit).alias("sensor_unit"),
        F.when(has_value, device).alias("source_device"),
        key.alias("business_key"), "err")
    return judged.select(*lines.columns, F.inline(F.array(result)))
