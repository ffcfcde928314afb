"""Observation times, zones, local minutes and business dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# ISO local date-time; "yyyy-MM-dd HH:mm:ss"; "yyyy-MM-dd HH:mm".
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{0,9})?)?\z"
_SPACED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}(?::[0-9]{2})?\z"
# What both forms have in common; nearly all times are written so.
_USUAL = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\z"
FUTURE_TOLERANCE = dt.timedelta(minutes=10)


def ntz(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """Time of trimmed text, cut to the second; null where no accepted form fits.

    The ISO form is strict. The spaced forms follow the lenient calendar rule of the usual pattern
    formatter: a day past the month's end becomes its last day, and 24:00 the next midnight.
    """
    number = lambda start, size: F.substring(text, start, size).try_cast("int")
    year, month, day = number(1, 4), number(6, 2), number(9, 2)
    hour, minute = number(12, 2), number(15, 2)
    second = F.when(F.length(text) >= 19, number(18, 2)).otherwise(0)

    iso = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    month_start = F.try_make_timestamp_ntz(
        year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    month_end = F.dayofmonth(F.last_day(month_start.cast("date")))
    midnight = (hour == 24) & (minute == 0) & (second == 0)
    spaced = F.try_make_timestamp_ntz(
        year, month, F.least(day, month_end), F.when(midnight, 0).otherwise(hour), minute,
        second.cast("decimal(16,6)"))
    spaced = F.when(midnight, spaced + F.expr("interval 1 day")).otherwise(spaced)
    careful = (
        F.when(text.rlike(_ISO) & (second < 60), iso)
        .when(text.rlike(_SPACED) & (year >= 1) & (day <= 31) & (second < 60), spaced)
    )
    # A time of the calendar is the same in either form; what the plain cast refuses takes the longer way.
    return F.coalesce(F.when(text.rlike(_USUAL), text.try_cast("timestamp_ntz")), careful)


def to_local(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def clock(local: Column) -> Column:
    return F.date_format(local, "HH:mm:ss")


def business_date(start_utc: Column, zone: Column) -> Column:
    return F.to_date(to_local(start_utc, zone))


def known_zones(spark) -> list[str]:
    """Region ids and fixed offsets the JVM accepts as region names; about 600 short strings."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def is_zone(zone: Column, zones: list[str]) -> Column:
    """A region name of this JVM, or a fixed offset of at most 18 hours."""
    offset = zone.rlike(
        r"^(?:UTC|GMT|UT)?(?:Z|[+-](?:[0-9]|0[0-9]|1[0-7])(?::[0-5][0-9])?|[+-]18(?::00)?)\z")
    return zone.isin(zones) | offset
