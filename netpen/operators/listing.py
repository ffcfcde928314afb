"""Filtered and ordered listings, range listings, lookups, first-N and pages."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
MAX_PAGE = 1000
NEWEST_OBSERVATIONS = 500

PAGE_GRAIN = 10_000  # values per block when a page is looked for

_NEWEST = lambda *cols: [F.col(c).desc() for c in cols]
_OLDEST = lambda *cols: [F.col(c).asc() for c in cols]

# Listing name -> filters a caller may give, and the order.
LISTINGS: dict[str, tuple[list[str], Any]] = {
    "fish_batch": (["cage_no", "status"], lambda: _NEWEST("stocking_time", "batch_id")),
    "feeding_plan": (["batch_id", "cage_no", "status"], lambda: _NEWEST("plan_id")),
    "sensor": (["cage_no", "sensor_type", "status"],
               lambda: [*_OLDEST("cage_no"), *_NEWEST("install_time"), *_OLDEST("sensor_id")]),
    "survival_report": (["batch_id", "cage_no"], lambda: _NEWEST("report_time", "report_id")),
    "harvest_batch": (["batch_id", "cage_no", "status"],
                      lambda: _NEWEST("harvest_time", "harvest_id")),
    "ts_rule": (["status", "rule_code"], lambda: _OLDEST("rule_code", "version_no")),
    "tide_session": (["cage_no", "business_date"], lambda: _OLDEST("start_at_utc", "tide_id")),
    "feed_observation": (["batch_id", "cage_no"], lambda: _OLDEST("observed_at_utc", "obs_id")),
    "migration_event": (["batch_id", "source_cage_no", "target_cage_no"],
                        lambda: _OLDEST("seq_no", "migration_no")),
    "calc_result": (["batch_id", "business_date"], lambda: _OLDEST("business_date", "batch_id")),
    "calc_detail": (["batch_id", "business_date"], lambda: _OLDEST("observed_at_utc", "obs_id")),
    "cage_sea_area": ([], lambda: _OLDEST("cage_no")),
    "sensor_reading": (["sensor_id", "cage_no"], lambda: _NEWEST("reading_time", "reading_id")),
    "feeding_record": (["batch_id", "cage_no", "posted"],
                       lambda: _NEWEST("feeding_time", "record_id")),
}
_RANGE_COLUMN = {"sensor_reading": "reading_time", "feeding_record": "feeding_time"}


def where_given(df: DataFrame, given: Mapping[str, Any]) -> DataFrame:
    """Equality filters, each applied only if its value is given; an empty text is not given."""
    wanted = [F.col(c) == v for c, v in given.items() if v is not None and v != ""]
    return functools.reduce(DataFrame.where, wanted, df)


def list_range(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows between two times, both ends included, each end optional."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df


def list_table(kind: str, df: DataFrame, start: Any = None, end: Any = None,
               **given: Any) -> DataFrame:
    """The listing of one table with its own filters and order."""
    allowed, order = LISTINGS[kind]
    unknown = set(given) - set(allowed)
    if unknown:
        raise ValueError(f"{kind} listing has no filter {sorted(unknown)}")
    df = where_given(df, given)
    if kind in _RANGE_COLUMN:
        df = list_range(df, _RANGE_COLUMN[kind], start, end)
    return df.orderBy(*order())


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows for a table of keys, and the keys that are not there."""
    keys = wanted.select(key).distinct()
    return df.join(keys, key, "left_semi"), keys.join(df.select(key), key, "left_anti")


def first_failures(ledger: DataFrame, group: str = "checksum", limit: int = 100) -> DataFrame:
    """The first failed rows of every file by line number.

    The rank limit is pushed below the shuffle (window group limit), so each task passes on at
    most ``limit`` rows per file.
    """
    by_line = Window.partitionBy(group).orderBy("line_no")
    return (
        ledger.where(F.col("outcome") == "FAILED")
        .withColumn("__rank", F.row_number().over(by_line))
        .where(F.col("__rank") <= max(limit, 1)).drop("__rank")
    )


def _holding(rows: DataFrame, column: str, grain: int, first: int, size: int) -> tuple[int, int, int] | None:
    """The lowest and highest block of ``column`` that the page reaches into, and the rows before them.

    Rows are counted per block with partial counts; one row per block is summed up in order.
    """
    counts = rows.groupBy(F.floor(F.col(column) / grain).alias("block")).count()
    before = F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    found = counts.withColumn("before", before).where(
        (F.col("before") < first + size) & (F.col("before") + F.col("count") > first)).agg(
        F.min("block"), F.max("block"), F.min("before")).first()
    return None if found[0] is None else tuple(found)


def page(rows: DataFrame, column: str, first: int, size: int, *ties: str) -> DataFrame:
    """``size`` rows from the one at ``first`` on, in order of a whole-number column, then of ``ties``.

    Nothing is sorted but the page: counts per block of values, then per value, tell which values the page
    holds and how many rows of the first value come before it, however far from the start that is.
    """
    begun, wanted = 0, rows
    for grain in (PAGE_GRAIN, 1):
        found = _holding(wanted, column, grain, first - begun, size)
        if found is None:
            return rows.limit(0)
        low, high, before = found
        begun += before
        wanted = rows.where(F.col(column).between(low * grain, (high + 1) * grain - 1))
    return wanted.orderBy(column, *ties).offset(first - begun).limit(size)


def outcome_page(ledger: DataFrame, checksum: str | None = None, outcome: str | None = None,
                 limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of row outcomes in line order, files of one line by checksum."""
    given = {"checksum": checksum, "outcome": outcome.upper() if outcome else None}
    return page(where_given(ledger, given), "line_no", max(offset, 0), min(max(limit, 1), MAX_PAGE), "checksum")


def newest_observations(observations: DataFrame, voyage_no: str | None = None,
                        cage_no: str | None = None, *ties: Column) -> DataFrame:
    found = where_given(observations, {"voyage_no": voyage_no, "cage_no": cage_no})
    order = ties or (F.col("voyage_no"), F.col("cage_no"))
    return found.orderBy(F.col("observed_at").desc(), *order).limit(NEWEST_OBSERVATIONS)
