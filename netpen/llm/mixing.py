"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is spent in complete epochs first; the rest of it goes to texts in the order of
their sampling keys until the words run out. A key is an exponential variate divided by the text's
quality weight, so a text comes first among the others with a chance in proportion to its weight.
The variate is a hash of the row and the seed: reruns agree.

Nothing orders a whole source. Keys are mapped to ``BUCKETS`` buckets that grow with them; words are
summed per source and bucket, and running sums over ranges of buckets, then over one range's buckets,
show the one bucket of a source in which its words run out. Only that bucket's texts are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netpen.llm.common import words_of
from netpen.session import stage

BUCKETS = 1 << 16
STEP = 1 << 8      # buckets in a range
WEIGHTS = (3, 1, 2)
SHARE = 1.5   # of all words, for the mix
MOST = 2.0    # times its source's words a target may be


def quality_weight(words: Column, text: Column) -> Column:
    """Between 0.25 and 1: the share of the words' characters that are letters or end a clause."""
    chars = F.length(F.array_join(words, ""))
    odd = F.regexp_count(text, F.lit("[^\\p{L}\\s.,;:!?'-]"))
    return F.when(chars > 0, F.greatest(1 - odd / chars, F.lit(0.25))).otherwise(F.lit(0.25))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from a table of source, source_size; one row per source.

    Sources by code point, null last, get the weights in turn. All targets make ``share`` of all words;
    one above ``most`` times its source's words stops there, and the excess is shared again by weight
    among the others until none is above.
    """
    if share > most:
        raise ValueError("the mix is larger than what the sources may give")
    ranked = _ranked(sizes).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = stage(ranked, "source-sizes")
    level = 0.0
    while True:  # once per round of sharing; each returns three sums
        full = F.col("weight") * level >= most * F.col("source_size")
        held, free, total = ranked.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        now = (share * total - held) / free if free else level
        if now <= level:
            break
        level = now
    target = F.least(F.col("weight") * level, most * F.col("source_size"))
    return ranked.select("source", "source_size", target.alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """``rank`` from 0 in the order of source; sorted by ranges, so no task has all sources.

    Only the number of sources per range reaches the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    ranges = stage(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "source-ranges")
    counts = sorted(ranges.groupBy("part").count().collect())
    before, starts = 0, []
    for row in counts:
        starts += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    start = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    return ranges.select("source", "source_size", (within + start).alias("rank"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = 1, keep: Sequence[str] | None = None, weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, most: float = MOST) -> DataFrame:
    """The kept columns (all but the text) with size, source_size, target and taken.

    ``size`` is the text's number of words (null: 0), ``taken`` how many of them the mix takes, repeats
    counted: whole epochs, then the text once more or a first part of it. At most ``most`` times
    the size. A source's taken words differ from its target by less than one. Texts without words take
    nothing. Rows that are equal in all columns may share out their words either way. An empty table
    gives an empty one.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else list(keep)
    added = ["size", "source_size", "target", "taken"]
    if clash := set(added) & set(keep):
        raise ValueError(f"columns already named {sorted(clash)}")
    words = words_of(F.col(f"`{text}`"))
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_")).alias("row"),
        F.col(f"`{source}`").alias("source"), clean.alias("text"), words.alias("words"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), clean).alias("hash"))
    rows = rows.select("row", "source", F.size("words").cast("long").alias("size"), "hash",
                       quality_weight(F.col("words"), F.col("text")).alias("weight"))
    # The hash as a number strictly between 0 and 1; -ln of it is an exponential variate.
    uniform = (F.shiftrightunsigned("hash", 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(uniform) / F.col("weight")
    rows = rows.select("row", "source", "size", "hash", key.alias("key"),
                       F.floor((1 - F.exp(-key)) * (BUCKETS - 1)).cast("int").alias("bucket"))
    # What the plan needs is written; rows that carry their texts are read again for the result.
    if text in keep:
        light = stage(rows.select("source", "size", "bucket"), "mix-keys")
    else:
        light = rows = stage(rows, "mix-keys")
    cells = stage(light.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    ranges = stage(cells.groupBy("source", F.floor(F.col("bucket") / STEP).cast("int").alias("range")).agg(
        F.sum("words").alias("words")), "mix-ranges")
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = stage(goals.withColumn("epochs", epochs.cast("long")).withColumn(
        "left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")
    # First the range of buckets in which a source's words run out, then the bucket in that range.
    edge_range = stage(_edge(ranges, goals.select("source", "left"), "range"), "mix-edge-ranges")
    within = cells.alias("c").join(edge_range.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")) & (
        F.floor(F.col("bucket") / STEP) == F.col("range"))).select("c.source", "bucket", "words")
    edge = _edge(within, edge_range.select("source", "left"), "bucket")
    plan = stage(goals.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select(
        F.col("g.source").alias("goal_source"), "source_size", "target", "epochs",
        F.col("bucket").alias("edge_bucket"), F.col("e.left").alias("left")), "mix-plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge_bucket"), F.lit(False))
    whole = F.col("edge_bucket").isNull() | (F.col("bucket") < F.col("edge_bucket"))
    others = joined.where(~at_edge).withColumn("again", F.when(whole, F.col("size")).otherwise(F.lit(0).cast("long")))
    sort = Window.partitionBy("source").orderBy("key", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    edges = joined.where(at_edge).withColumn(
        "again", F.least("size", F.greatest(
            F.col("left") - F.coalesce(F.sum("size").over(sort), F.lit(0)), F.lit(0))))
    return others.unionByName(edges).select(
        *[F.col("row")[c].alias(c) for c in keep], "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("again")).alias("taken"))


def _edge(cells: DataFrame, budgets: DataFrame, at: str) -> DataFrame:
    """Per source the first cell whose words the budget ``left`` does not cover, and what it has for it.

    Running sums over at most ``BUCKETS / STEP`` or ``STEP`` cells of a source.
    """
    in_order = Window.partitionBy("source").orderBy(at)
    ends = cells.withColumn("end", F.sum("words").over(in_order)).alias("c").join(
        budgets.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")))
    found = ends.where(F.col("end") > F.col("left")).groupBy(F.col("c.source").alias("source")).agg(
        F.min(F.struct(at, (F.col("left") - (F.col("end") - F.col("words"))).alias("left"))).alias("edge"))
    return found.select("source", "edge.*")


def spread(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of ``mix`` once per whole epoch, then the first words of a part.

    The four columns that ``mix`` adds are gone; a part is its words joined by one space.
    """
    words = F.slice(words_of(F.col(f"`{text}`")), 1, F.greatest(F.col("part"), F.lit(1)))
    rows = mixed.where("taken > 0").withColumns({
        "part": (F.col("taken") % F.col("size")).cast("int"),
        "whole": F.floor(F.col("taken") / F.col("size")).cast("int")})
    copies = F.concat(F.array_repeat(F.lit(False), F.col("whole")),
                      F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn("is_part", F.explode(copies))
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    new = F.when(F.col("is_part"), F.array_join(words, " ")).otherwise(F.col(f"`{text}`"))
    return rows.select(*[new.alias(text) if c == text else F.col(f"`{c}`") for c in kept])
