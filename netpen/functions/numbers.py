"""Decimal text and counts derived from rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SHAPE = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,9})?\z"


def _stripped_scale(text: Column) -> Column:
    """Digits after the point once trailing zeros are gone; 0 for a zero value."""
    fraction = F.regexp_extract(text, r"\.([0-9]*)", 1)
    digits = F.concat(F.regexp_extract(text, r"^[+-]?([0-9]*)", 1), fraction)
    exponent = F.coalesce(
        F.regexp_extract(text, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("bigint"), F.lit(0))
    trailing = F.length(digits) - F.length(F.regexp_replace(digits, r"0+\z", ""))
    return F.when(digits.rlike("[1-9]"), F.length(fraction) - exponent - trailing).otherwise(0)


def parse_decimal(text: Column, max_scale: int) -> Column:
    """Struct (value, negative, problem) of already trimmed text; all null for null text.

    ``problem`` is ``not_a_number``, ``too_many_decimals`` or ``out_of_range`` (beyond 20 integer
    digits, far over every limit used here).
    """
    plain = text.rlike(rf"^[0-9]{{1,18}}(?:\.[0-9]{{1,{max_scale}}})?\z")
    simple = F.struct(text.try_cast("decimal(38,18)").alias("value"), F.lit(False).alias("negative"),
                      F.lit(None).cast("string").alias("problem"))
    shaped = text.rlike(_SHAPE)
    value = F.when(shaped, text.try_cast("decimal(38,18)"))
    problem = (
        F.when(~shaped, "not_a_number")
        .when(_stripped_scale(text) > max_scale, "too_many_decimals")
        .when(value.isNull(), "out_of_range")
    )
    negative = shaped & text.startswith("-") & text.rlike(r"^-[0-9.]*[1-9]")
    careful = F.struct(value.alias("value"), negative.alias("negative"), problem.alias("problem"))
    # Nearly all numbers are plain; the other forms take the longer way.
    return F.when(text.isNull() | plain, simple).otherwise(careful)


def survival_rate(given: Column, alive: Column, stocked: Column) -> Column:
    """The given rate, else alive / stocked to 4 places half up, 0 where nothing was stocked."""
    ratio = F.round(alive.cast("decimal(20,0)") / stocked.cast("decimal(10,0)"), 4)
    derived = F.when(stocked == 0, F.lit(0).cast("decimal(7,4)")).otherwise(ratio.cast("decimal(7,4)"))
    return F.coalesce(given.cast("decimal(7,4)"), derived)


def alive_count(rate: Column, stocked: Column) -> Column:
    """rate x stocked, half up to an integer and at most stocked; 0 for an unknown batch."""
    alive = F.least(F.round(rate * stocked.cast("decimal(10,0)"), 0).cast("int"), stocked)
    return F.coalesce(alive, F.lit(0))
