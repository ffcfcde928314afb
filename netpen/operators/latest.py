"""Row helpers: latest and first row per key as aggregates, columns computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_ID_SPAN = 10 ** 20


def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns through a one-element generator.

    The optimizer neither merges projections nor pushes filters through it, so what is computed here
    is computed once per row, however often later expressions and filters refer to it.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def recency(time: Column, row_id: Column, lower_id_wins: bool = False) -> Column:
    """One number that orders rows by time and then by id.

    A decimal, so that ``max_by`` over fixed-width values stays a hash aggregate; a struct would
    force a sort of the whole input.
    """
    micros = F.unix_micros(time.cast("timestamp")).cast("decimal(18,0)")
    span = F.lit(str(_ID_SPAN)).cast("decimal(21,0)")
    rank = (-row_id if lower_id_wins else row_id).cast("decimal(20,0)")
    return (micros * span + rank).cast("decimal(38,0)")


def latest(df: DataFrame, key: str, time: str, row_id: str, values: Sequence[str],
           lower_id_wins: bool = False) -> DataFrame:
    """``key``, ``time``, ``row_id`` and ``values`` of each key's newest row; nulls are kept."""
    order = recency(F.col(time), F.col(row_id), lower_id_wins)
    return (
        df.withColumn("__recency", order).groupBy(key)
        .agg(*[F.max_by(v, "__recency").alias(v) for v in (time, row_id, *values)])
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  flag: str = "is_first") -> DataFrame:
    """Add ``flag``: whether the row is the first of its key; ``order`` must tell rows apart.

    The first rows come from a partial aggregate and are joined back on key and order together, so
    a key with very many rows neither lands in one window nor in one join bucket.
    """
    rest = [c for c in order if c not in keys]
    if len(rest) == 1:
        # A plain minimum stays a hash aggregate.
        firsts = df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0]), F.lit(True).alias(flag))
    else:
        firsts = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first")).select(
            *keys, *[F.col(f"__first.{c}").alias(c) for c in rest], F.lit(True).alias(flag))
    on = [*keys, *rest]
    return df.join(firsts, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
