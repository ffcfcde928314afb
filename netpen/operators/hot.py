"""Operators that stay balanced when one key holds a large share of all rows.

Catalyst's window puts a whole key into one task and AQE cannot split it; AQE's skew join cannot
split a side that is itself an aggregate on the join key. Both operators here first look for hot
keys and only treat those specially. Without any, the plan is the plain join or window.

The look counts rows per bucket of key hashes, of which there are so many that a bucket without a hot
key stays far below the limit, and then the keys of the buckets over it alone: what it shuffles is
bounded by the buckets, not by the keys. A key is hot if it has more rows than a shuffle partition would
on average, so there are fewer hot keys than shuffle partitions, whatever the data holds, and the
numbers of their buckets and their 8-byte hashes are all that reaches the driver. A hot key is salted into as many parts as it has such shares. Only the route of
a row depends on the list, never the result, so a hash collision or a stale list is harmless.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from netpen.session import stage

MIN_HOT_ROWS = 100_000  # a key with fewer rows is no burden to any task
MIN_BUCKETS, BUCKETS_PER_PARTITION = 4096, 16  # of key hashes; a bucket's share is a sixteenth of a partition's

_CHUNK, _SALT = "__chunk", "__salt"


class HotKeys(list):
    """Hashes of hot keys, and the number of parts that the heaviest is dealt into."""

    salts = 16


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> HotKeys:
    """Hashes of the keys with more than ``hot_rows`` rows, or than an average partition's share."""
    return hot_keys_of(df, hot_rows, key=keys)["key"]


def hot_keys_of(df: DataFrame, hot_rows: int | None = None,
                **groups: Sequence[str]) -> dict[str, HotKeys]:
    """``hot_keys`` for several keys of one table: one pass, and one over the rows of heavy buckets if there are any."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(MIN_BUCKETS, BUCKETS_PER_PARTITION * width)
    hashes = [F.struct(F.lit(i).alias("g"), F.xxhash64(*keys).alias("h")) for i, keys in enumerate(groups.values())]
    every = df.select(F.inline(F.array(*hashes))).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    seen = Observation()
    least = MIN_HOT_ROWS if hot_rows is None else hot_rows
    heavy = (every.groupBy("g", "bucket").count().observe(seen, F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
             .where(F.col("count") > least).collect())
    share = least if hot_rows is not None else max(least, seen.get["n"] / len(groups) / width)
    heavy = {i: [row.bucket for row in heavy if row.g == i and row["count"] > share] for i in range(len(groups))}
    rows = []
    if any(heavy.values()):
        asked = [(F.col("g") == i) & F.col("bucket").isin(at) for i, at in heavy.items() if at]
        # No more keys than shuffle partitions can exceed an average share.
        rows = every.where(functools.reduce(Column.__or__, asked)).groupBy("g", "h").count().where(
            F.col("count") > share).collect()
    found = {}
    for i, name in enumerate(groups):
        mine = [row for row in rows if row.g == i]
        found[name] = HotKeys(row.h for row in mine)
        if mine and hot_rows is None:
            found[name].salts = 1 + int(max(row["count"] for row in mine) / share)
    return found


def is_hot(keys: Sequence[str], hot: Sequence[int]) -> Column:
    return F.xxhash64(*keys).isin(list(hot))


def skew_join(fact: DataFrame, dim: DataFrame, keys: Sequence[str], row_id: Sequence[str],
              how: str = "left", hot_rows: int | None = None, salts: int | None = None,
              condition: Column | None = None, hot: Sequence[int] | None = None) -> DataFrame:
    """Equi-join of a large side that may hold hot keys with a side that holds few rows per key.

    Rows of a hot key are spread over ``salts`` parts by a hash of ``row_id`` (columns that tell
    rows apart, so that copies spread too) and the few matching rows are repeated once per part.
    ``how`` is inner, left, left_semi or left_anti; ``condition`` may add a range predicate.
    """
    hot = hot_keys(fact, keys, hot_rows) if hot is None else hot
    on = list(keys)
    if hot:
        salts = getattr(hot, "salts", HotKeys.salts) if salts is None else salts
        none = F.lit(0)
        fact = fact.withColumn(_SALT, F.when(
            is_hot(keys, hot), F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")).otherwise(none))
        dim = dim.withColumn(_SALT, F.explode(
            F.when(is_hot(keys, hot), F.sequence(none, F.lit(salts - 1))).otherwise(F.array(none))))
        on.append(_SALT)
    if condition is None:
        return fact.join(dim, on, how).drop(_SALT)
    right = dim.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in dim.columns])
    for name in on:
        condition = condition & (F.col(name) == F.col(f"__r_{name}"))
    return fact.join(right, condition, how).drop(_SALT, *[f"__r_{c}" for c in on])


class OrderedScan:
    """Values carried along each key's rows in order, exact for hot keys too.

    Every carry is one of: the last non-null value, the maximum, or the row count over the rows
    strictly before the current one. All three combine associatively, so the rows of a hot key are
    cut into ``chunk`` pieces that are scanned in parallel; a short second scan over one summary row
    per piece supplies what each piece starts with. Cold keys have a single piece.

    Pieces are cut at quantiles of key and whole order, as many as shuffle partitions, so they are even
    however the rows lie: in one second, or with gaps of years. The quantiles come from a sample, so the cut rows
    are written once and stay in their pieces. Where blocks of known size are at hand, ``chunk`` may name
    them instead: it must grow with ``order``, as its leading part, coarsened.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None = None,
                 hot_rows: int | None = None, hot: Sequence[int] | None = None):
        self.keys, self.order = list(keys), list(order)
        self.hot = hot_keys(df, keys, hot_rows) if hot is None else hot
        self.pieces = [*self.keys, _CHUNK] if self.hot else self.keys
        if not self.hot:
            self.df = df
        elif chunk is not None:
            self.df = df.withColumn(_CHUNK, F.when(is_hot(keys, self.hot), F.struct(chunk.alias("at"))))
        else:
            self.df = self._cut(df)

    def _cut(self, df: DataFrame) -> DataFrame:
        """Hot rows with the number of their range of keys and order; cold rows without a piece."""
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = is_hot(self.keys, self.hot)
        cut = df.where(hot).repartitionByRange(width, *self.keys, *self.order).withColumn(
            _CHUNK, F.struct(F.spark_partition_id().alias("at")))
        cut = stage(cut, "scan-pieces")
        return cut.unionByName(df.where(~hot).withColumn(_CHUNK, F.lit(None).cast(cut.schema[_CHUNK].dataType)))

    def carry(self, last: Mapping[str, Column] | None = None,
              maximum: Mapping[str, Column] | None = None,
              count: str | None = None) -> "OrderedScan":
        """Add the named columns to every row."""
        last, maximum = dict(last or {}), dict(maximum or {})
        inputs = {f"__in_{n}": c for n, c in {**last, **maximum}.items()}
        rows = self.df.withColumns(inputs) if inputs else self.df
        starts = self._starts(rows, last, maximum, count) if self.hot else None

        before = (Window.partitionBy(*self.pieces).orderBy(*self.order)
                  .rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumns({
            **{n: F.last(f"__in_{n}", ignorenulls=True).over(before) for n in last},
            **{n: F.max(f"__in_{n}").over(before) for n in maximum},
            **({count: F.count(F.lit(1)).over(before)} if count else {}),
        }).drop(*inputs)
        if starts is not None:
            # Cold rows have no piece and match nothing; a hot row matches its piece's start.
            rows = rows.join(starts, self.pieces, "left").withColumns({
                **{n: F.coalesce(n, f"__start_{n}") for n in last},
                **{n: F.greatest(n, f"__start_{n}") for n in maximum},
                **({count: F.coalesce(f"__start_{count}", F.lit(0)) + F.col(count)} if count else {}),
            }).drop(*[f"__start_{n}" for n in [*last, *maximum, count] if n])
        self.df = rows
        return self

    def _starts(self, rows: DataFrame, last: Mapping, maximum: Mapping,
                count: str | None) -> DataFrame:
        """What each piece of a hot key starts with: one row per piece."""
        position = F.struct(*self.order)
        summary = rows.where(F.col(_CHUNK).isNotNull()).groupBy(*self.pieces).agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), position))
              .alias(f"__in_{n}") for n in last],
            *[F.max(f"__in_{n}").alias(f"__in_{n}") for n in maximum])
        earlier = (Window.partitionBy(*self.keys).orderBy(_CHUNK)
                   .rowsBetween(Window.unboundedPreceding, -1))
        return summary.select(
            *self.pieces,
            *[F.last(f"__in_{n}", ignorenulls=True).over(earlier).alias(f"__start_{n}") for n in last],
            *[F.max(f"__in_{n}").over(earlier).alias(f"__start_{n}") for n in maximum],
            *([F.sum("__n").over(earlier).alias(f"__start_{count}")] if count else []))

    def add(self, **columns: Column) -> "OrderedScan":
        self.df = self.df.withColumns(columns)
        return self

    def rows(self) -> DataFrame:
        return self.df.drop(_CHUNK)


def line_chunk(line: Column, size: int = 100_000) -> Column:
    return F.floor(line / size)
