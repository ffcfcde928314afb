"""Interval work: tide clipping and overlap, range join by hour bucket, rules by minute."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from netpen.functions import ring
from netpen.operators.hot import OrderedScan, skew_join



def hour_buckets(start: str, end: str) -> Column:
    """Hours touched by the half-open interval [start, end)."""
    last = F.col(end) - F.expr("interval 1 microsecond")
    return F.sequence(F.date_trunc("hour", start).cast("timestamp_ntz"),
                      F.date_trunc("hour", last).cast("timestamp_ntz"),
                      F.expr("interval 1 hour"))


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str,
               end: str, row_id: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Points joined with the intervals [start, end) of the same keys that hold them.

    The inequality becomes an equi-join on the hour; the exact bounds are checked inside it.
    """
    bucketed = intervals.where(F.col(start) < F.col(end)).withColumn(
        "__hour", F.explode(hour_buckets(start, end)))
    hourly = points.withColumn("__hour", F.date_trunc("hour", at).cast("timestamp_ntz"))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return skew_join(hourly, bucketed, [*keys, "__hour"], row_id, "inner", hot_rows,
                     condition=inside).drop("__hour")


def day_segments(tides: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each (cage, business date) envelope cut into disjoint segments.

    Tides are taken by (start, id); the first tide that holds a moment owns it, so a later tide
    only keeps what lies beyond the furthest earlier end. What no tide holds between the day's first
    start and last end becomes a segment without tide. A moment of the envelope therefore falls
    into exactly one segment.
    """
    scan = OrderedScan(tides, ["cage_no", "business_date"], ["start_at_utc", "tide_id"], hot_rows=hot_rows)
    reached = scan.carry(maximum={"reached": F.col("end_at_utc")}).rows()
    own = F.struct(
        F.greatest("start_at_utc", "reached").alias("seg_start"),
        F.col("end_at_utc").alias("seg_end"), F.lit(True).alias("in_tide"))
    gap = F.struct(
        F.col("reached").alias("seg_start"),
        F.col("start_at_utc").alias("seg_end"), F.lit(False).alias("in_tide"))
    pieces = reached.withColumn("__seg", F.explode(F.array(own, gap))).select(
        "cage_no", "business_date", "__seg.*",
        *[F.when(F.col("__seg.in_tide"), F.col(c)).alias(c)
          for c in ("tide_id", "tide_no", "start_at_utc", "end_at_utc")])
    return pieces.where(F.col("seg_start") < F.col("seg_end"))


def tide_overlaps(tides: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Tides that meet an earlier tide (by start, then id) of the same cage."""
    scan = OrderedScan(tides, ["cage_no"], ["start_at_utc", "tide_id"], hot_rows=hot_rows)
    reached = scan.carry(maximum={"reached": F.col("end_at_utc")}).rows()
    return reached.where(F.col("start_at_utc") < F.col("reached")).drop("reached")


def rules_by_minute(rules: DataFrame) -> DataFrame:
    """The rule that applies to each minute of the day: the first by (start, code).

    At most 1440 rows whatever the rule table holds, so the result may be broadcast.
    """
    rule = F.struct("rule_id", "rule_code", "version_no", "rule_type", "coefficient")
    order = F.struct("start_minute", "rule_code", "rule_id")
    return (
        rules.withColumn("minute", F.explode(ring.minutes(F.col("start_minute"), F.col("end_minute"))))
        .groupBy("minute").agg(F.min_by(rule, order).alias("rule"))
        .select("minute", "rule.*")
    )


def rule_overlaps(rules: DataFrame) -> DataFrame:
    """Rules that share a minute with a rule of another code, and the first such rule.

    The first rule of another code is the first one met, or the first whose code is not that one's; so two
    rules of different codes per interval, per minute and per stretch of minutes are enough for every rule,
    and neither pairs nor a rule's minutes are formed. There are at most 1440 * 1440 intervals.
    """
    minutes = F.least(ring.length(F.col("start_minute"), F.col("end_minute")), F.lit(ring.DAY_MINUTES))
    arcs = rules.withColumns({"__at": F.pmod("start_minute", F.lit(ring.DAY_MINUTES)).cast("int"),
                              "__minutes": minutes.cast("int")})
    arc = ["start_minute", "__at", "__minutes"]
    # Of each interval the first rule, and the first of its codes after that.
    by_code = arcs.where("rule_code is not null").groupBy(*arc, "rule_code").agg(F.min("rule_id").alias("rule_id"))
    rank = F.row_number().over(Window.partitionBy(*arc).orderBy("rule_code"))
    kept = by_code.withColumn("__rank", rank).where("__rank <= 2").drop("__rank")
    spans = kept.groupBy("start_minute").applyInPandas(
        _reaching, "at int, minutes int, start_minute int, rule_code string, rule_id long")
    per_minute = spans.withColumn("minute", F.explode(ring.minutes(F.col("at"), F.col("at") + F.col("minutes"))))
    firsts = per_minute.groupBy("minute", "rule_code").agg(F.min(F.struct("start_minute", "rule_id")).alias("rule"))
    order = Window.partitionBy("minute").orderBy("rule.start_minute", "rule_code", "rule.rule_id")
    firsts = firsts.withColumn("__rank", F.row_number().over(order)).where("__rank <= 2").select(
        "minute", "rule.start_minute", "rule_code", "rule.rule_id")
    # At most two rules for each of 1440 minutes go in, and for each stretch of 2^n minutes come out.
    met = F.broadcast(firsts.groupBy(F.lit(0).alias("day")).applyInPandas(
        _stretches, "at int, level int, met array<struct<start_minute int, rule_code string, rule_id long>>"))
    level = F.length(F.bin("__minutes")) - 1
    asked = arcs.where("__minutes > 0").withColumn("level", level).select(
        "rule_id", "rule_code", "version_no", "__at", "level",
        F.expr(f"pmod(__at + __minutes - shiftleft(1, level), {ring.DAY_MINUTES})").alias("__last"))
    both = asked.join(met.select(F.col("at").alias("__at"), "level", F.col("met").alias("__met")), ["__at", "level"]).join(
        met.select(F.col("at").alias("__last"), "level", F.col("met").alias("__also")), ["__last", "level"])
    other = F.array_min(F.filter(F.concat("__met", "__also"), lambda r: r["rule_code"] != F.col("rule_code")))
    return (
        both.withColumn("other", other).where(F.col("other").isNotNull())
        .groupBy("rule_id", "rule_code", "version_no").agg(F.min("other").alias("other"))
        .select("rule_id", "rule_code", "version_no", F.col("other.rule_id").alias("other_rule_id"),
                F.col("other.rule_code").alias("other_rule_code"))
    )


def _two(rules: list[tuple]) -> list[tuple]:
    """The first rule in order, and the first of another code."""
    found = sorted(rules)[:1]
    return found + sorted(r for r in rules if r[1] != found[0][1])[:1] if found else found


def _reaching(rules):
    """For the intervals of one start, at most 1440: the two rules that reach a minute, per run of minutes with the same."""
    start, at = int(rules["start_minute"].iloc[0]), int(rules["__at"].iloc[0])
    out, held, by_length = [], [], {}
    for minutes, code, rule in zip(rules["__minutes"].tolist(), rules["rule_code"], rules["rule_id"].tolist()):
        by_length.setdefault(minutes, []).append((start, code, rule))
    lengths = sorted((n for n in by_length if n > 0), reverse=True)
    for minutes, shorter in zip(lengths, [*lengths[1:], 0]):
        held = _two(held + by_length[minutes])
        out += [((at + shorter) % ring.DAY_MINUTES, minutes - shorter, *r) for r in held]
    return pd.DataFrame(out, columns=["at", "minutes", "start_minute", "rule_code", "rule_id"])


def _stretches(firsts):
    """The two rules met within 2^n minutes from each minute on; each level joins two stretches of the one below."""
    day = ring.DAY_MINUTES
    held = [[] for _ in range(day)]
    for minute, *rule in zip(firsts["minute"].tolist(), firsts["start_minute"].tolist(), firsts["rule_code"],
                             firsts["rule_id"].tolist()):
        held[minute].append(tuple(rule))
    out, level = [], 0
    while 1 << level <= day:
        out += [(at, level, sorted(rules)) for at, rules in enumerate(held)]
        held = [_two(list({*held[at], *held[(at + (1 << level)) % day]})) for at in range(day)]
        level += 1
    frame = pd.DataFrame(out, columns=["at", "level", "met"])
    frame["met"] = [[dict(zip(("start_minute", "rule_code", "rule_id"), r)) for r in rules] for rules in frame["met"]]
    return frame
