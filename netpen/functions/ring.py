"""Minute-of-day intervals [start, end) on a ring; end <= start wraps past midnight."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value.
DAY_MINUTES = 1440


def is_valid(start: Column, end: Column) -> Column:
    in_day = start.between(0, DAY_MINUTES - 1) & end.between(1, DAY_MINUTES)
    return F.coalesce(in_day & (start != end), F.lit(False))


def is_full_day(start: Column, end: Column) -> Column:
    return (start == 0) & (end == DAY_MINUTES)


def wraps(start: Column, end: Column) -> Column:
    return end <= start


def length(start: Column, end: Column) -> Column:
    return F.when(wraps(start, end), end - start + DAY_MINUTES).otherwise(end - start)


def offset(start: Column, minute: Column) -> Column:
    """Minutes from ``start`` forward round the ring to ``minute``."""
    return F.pmod(minute - start, F.lit(DAY_MINUTES))


def contains(start: Column, end: Column, minute: Column) -> Column:
    return offset(start, minute) < length(start, end)


def overlaps(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Two arcs meet exactly when one of them holds the other's first minute."""
    return contains(start1, end1, start2) | contains(start2, end2, start1)


def minutes(start: Column, end: Column) -> Column:
    """Every minute of the interval, at most 1440."""
    steps = F.sequence(F.lit(0), length(start, end) - 1)
    return F.transform(steps, lambda i: F.pmod(start + i, F.lit(DAY_MINUTES)))


def label(minute: Column) -> Column:
    """HH:mm, with 24:00 for the end of the day."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)
