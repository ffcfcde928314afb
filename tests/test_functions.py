"""Column helpers against plain Python readings of the same rules."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from netpen.functions import numbers, ring, text, times


def python_fields(line):
    """Fields of a line by walking its characters."""
    fields, field, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1:i + 2] == '"':
            field, i = field + '"', i + 1
        elif quoted and c == '"':
            quoted = False
        elif not quoted and c == '"' and not field:
            quoted = True
        elif not quoted and c == ",":
            fields.append(field)
            field = ""
        else:
            field += c
        i += 1
    control = "".join(chr(n) for n in range(33))
    return [f.strip(control) for f in [*fields, field]]


def test_csv_fields_equal_character_walk(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice('ab,"" \t') for _ in range(rng.randrange(0, 24))) for _ in range(4000)]
    lines += ['"VOY-6","CAGE","x, y","say ""hi""",""', 'a,"unclosed, to the end', '"a"b"c,d', ""]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    for row in df.select("i", text.csv_fields(F.col("line")).alias("fields")).collect():
        assert row.fields == python_fields(lines[row.i]), lines[row.i]


@pytest.mark.parametrize("value, scale, expected", [
    ("12.50", 2, (Decimal("12.5"), None)), ("1E1", 2, (Decimal("10"), None)), ("+5", 2, (Decimal("5"), None)),
    (".5", 2, (Decimal("0.5"), None)), ("5.", 2, (Decimal("5"), None)), ("1.2300", 2, (Decimal("1.23"), None)),
    ("1.234", 2, (Decimal("1.234"), "too_many_decimals")), ("0.000000", 2, (Decimal("0"), None)),
    ("1E-3", 2, (Decimal("0.001"), "too_many_decimals")), ("abc", 2, (None, "not_a_number")),
    ("1,5", 2, (None, "not_a_number")), ("1E40", 2, (None, "out_of_range")), ("", 2, (None, "not_a_number")),
    ("1200E-3", 2, (Decimal("1.2"), None)),
])
def test_parse_decimal(spark, value, scale, expected):
    row = spark.createDataFrame([(value,)], "v string").select(
        numbers.parse_decimal(F.col("v"), scale).alias("n")).first().n
    assert (None if row.value is None else row.value.normalize(), row.problem) == (
        None if expected[0] is None else expected[0].normalize(), expected[1])


@pytest.mark.parametrize("value, expected", [
    ("2026-09-10T08:00:00", "2026-09-10T08:00:00"), ("2026-09-10T08:00", "2026-09-10T08:00:00"),
    ("2026-09-10t08:00:01.987", "2026-09-10T08:00:01"), ("2026-09-10 08:00:05", "2026-09-10T08:00:05"),
    ("2026-09-10 08:00", "2026-09-10T08:00:00"), ("2026-09-10", None), ("2026-02-30T08:00:00", None),
    ("2026-02-30 08:00:00", "2026-02-28T08:00:00"), ("2026-09-10 24:00", "2026-09-11T00:00:00"),
    ("2026-09-10T24:00:00", None), ("2026-13-01 00:00", None), ("2026-09-10 08:00:60", None),
    ("not-a-time", None), ("2026-09-10 25:00", None), ("2026-04-32 08:00", None),
])
def test_parse_time(spark, value, expected):
    got = spark.createDataFrame([(value,)], "v string").select(times.parse_time(F.col("v")).alias("t")).first().t
    assert got == (None if expected is None else dt.datetime.fromisoformat(expected))


def ring_minutes(start, end):
    return {m % 1440 for m in range(start, end if end > start else end + 1440)}


def test_ring_intervals_equal_minute_sets(spark):
    arcs = [(360, 600), (600, 720), (599, 700), (1320, 120), (0, 120), (120, 360), (1200, 1320),
            (1260, 1380), (1290, 60), (180, 1260), (0, 1440), (1439, 1), (5, 6)]
    pairs = [(*a, *b) for a in arcs for b in arcs]
    df = spark.createDataFrame(pairs, "s1 int, e1 int, s2 int, e2 int")
    for row in df.withColumn("hit", ring.overlaps(*[F.col(c) for c in ("s1", "e1", "s2", "e2")])).collect():
        assert row.hit == bool(ring_minutes(row.s1, row.e1) & ring_minutes(row.s2, row.e2)), row
    one = spark.createDataFrame(arcs, "s int, e int").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(7))))
    for row in one.withColumn("hit", ring.contains(F.col("s"), F.col("e"), F.col("m"))).collect():
        assert row.hit == (row.m in ring_minutes(row.s, row.e)), row
    listed = spark.createDataFrame(arcs, "s int, e int").withColumn("ms", ring.minutes(F.col("s"), F.col("e")))
    for row in listed.collect():
        assert set(row.ms) == ring_minutes(row.s, row.e) and len(row.ms) == len(set(row.ms))


def test_ring_validity_and_labels(spark):
    df = spark.createDataFrame([(0, 1440), (0, 0), (1440, 10), (10, 1441), (-1, 5), (5, 5), (1320, 120)], "s int, e int")
    assert [r.v for r in df.select(ring.is_valid(F.col("s"), F.col("e")).alias("v")).collect()] == [
        True, False, False, False, False, False, True]
    labels = spark.createDataFrame([(0,), (75,), (1440,)], "m int").select(ring.label(F.col("m")).alias("l")).collect()
    assert [r.l for r in labels] == ["00:00", "01:15", "24:00"]


def test_counts_and_rates(spark):
    df = spark.createDataFrame([(9500, 10000), (1, 3), (2, 3), (5, 0)], "alive int, stocked int")
    got = df.select(numbers.survival_rate(F.lit(None), F.col("alive"), F.when(F.col("stocked") > 0, F.col("stocked")).otherwise(0)).alias("r")).collect()
    assert [str(r.r) for r in got] == ["0.9500", "0.3333", "0.6667", "0.0000"]
    alive = df.select(numbers.alive_count(F.lit("0.95005").cast("decimal(7,4)"), F.col("stocked")).alias("a")).collect()
    assert [r.a for r in alive] == [9501, 3, 3, 0]
    unknown = df.limit(1).select(numbers.alive_count(F.lit("0.5").cast("decimal(7,4)"), F.lit(None).cast("int")).alias("a"))
    assert unknown.first().a == 0


def test_trim_strips_control_characters(spark):
    df = spark.createDataFrame([("\t\x00 a b \x1f ",), (" x",)], "v string")
    assert [r.t for r in df.select(text.jtrim(F.col("v")).alias("t")).collect()] == ["a b", " x"]


def test_derived_number_and_zone(spark):
    row = spark.range(1).select(
        text.derived_no("FR-", F.lit("V|C|2026-09-10T08:00:00")).alias("n"),
        times.business_date(times.ntz("2026-09-13 16:30:00"), F.lit("Asia/Shanghai")).alias("east"),
        times.business_date(times.ntz("2026-09-13 16:30:00"), F.lit("UTC")).alias("utc")).first()
    assert len(row.n) == 32 and str(row.east) == "2026-09-14" and str(row.utc) == "2026-09-13"
    zones = spark.createDataFrame([("Asia/Shanghai",), ("Mars/Base",), ("+08:00",), ("UTC",), ("+19:00",)], "z string")
    known = times.known_zones(spark)
    assert [r.ok for r in zones.select(times.is_zone(F.col("z"), known).alias("ok")).collect()] == [
        True, False, True, True, False]
