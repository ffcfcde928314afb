"""Filter interaction audit: what each filter of an ordered chain removes, for every order.

The relations are small. ``facts`` has one row per document: its id, its part, its labels. Each filter has
a table of its own with the ids of the documents that fail it. Filter by filter, a left-semi join takes
the documents of each class so far that fail it and a left-anti join those that do not, so that after
the last one each class is the exact intersection of id tables and complements of others: 2^n classes for
n filters. A prefix's survivors are the classes outside all its id tables (left-anti by each), its
removals those inside the next one and outside all before, its redundancies those inside both; so all
orders follow from the classes' counts, which are one row per part, class and label.

Every join is on the document's id, which no two documents share; a hot part is only counted, with
partial sums before the shuffle. Each filter's classes are written before the next one, which cuts the
lineage; ids, parts and flags are all that is written or shuffled.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from netpen.llm.common import words_of
from netpen.operators.hot import skew_join
from netpen.session import stage

MAX_FILTERS = 6  # 720 orders; the result has one row per part, order and step

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides: too short, repetitive, shouting, markup."""
    words = words_of(text)
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_facts(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``part`` (the source; null: empty) and a flag per text filter.

    Id and digest together name a document: rows that repeat both fail the same filters.
    """
    clean = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("text"),
                       F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("part"))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part",
                       *[flag.alias(name) for name, flag in text_filters(F.col("text")).items()])


def repeated_texts(facts: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Id and digest of the documents whose text a smaller id has too.

    Each text's smallest id is an aggregate with partial results; a text that very many documents share is
    salted when its documents meet that one row. A document without an id is no smaller one and never fails.
    """
    rows = facts.where(F.col("doc_id").isNotNull()).select("doc_id", "digest").distinct()
    first = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                  .where("first < last").drop("last"), "first-ids")
    return skew_join(rows, first, ["digest"], ["doc_id"], "inner", hot_rows).where(
        F.col("doc_id") > F.col("first")).select("doc_id", "digest")


def audit(facts: DataFrame, failing: dict[str, DataFrame], labels: dict[str, DataFrame],
          key: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, counting documents of the part.

    ``facts`` has the ``key`` columns and ``part``; ``failing`` maps a filter's name to the keys that fail it, of
    which there may be repeats; ``labels`` maps a column of the result to the ids (first key column) whose
    removal it counts. ``filter_order`` joins the names; the step's filter is the one at that place.
    ``kept``, ``removed``: after and in this step. ``redundant``: fails this step's filter, removed earlier.
    ``unique_fails``: fails this filter only. ``shapley``: what the filter removes, summed over all orders.
    Keys may be null. Repeated rows each count. Without facts there are no rows.
    """
    if not 1 <= len(failing) <= MAX_FILTERS:
        raise ValueError(f"filters: from 1 to {MAX_FILTERS}")
    names = list(failing)
    rows = facts.select(*key, "part")
    for label, ids in labels.items():
        ids = ids.select(F.col(ids.columns[0]).alias("__id")).where(F.col("__id").isNotNull()).distinct()
        rows = _split(rows, ids, F.col(key[0]) == F.col("__id"), label, 1)
    rows = stage(rows.withColumn("fails", F.lit(0)), "labelled")
    for place, name in enumerate(names):
        ids = failing[name].select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        rows = stage(_split(rows, ids, same, "fails", 1 << place), f"after-{place}")
    classes = rows.groupBy("part", "fails", *labels).agg(F.count("*").alias("n"))
    return _orders(classes, names, list(labels))


def _split(rows: DataFrame, ids: DataFrame, same, flag: str, bit: int) -> DataFrame:
    """Rows within the ids with ``bit`` added to their flag, and rows outside them."""
    before = F.col(flag) if flag in rows.columns else F.lit(0)
    inside = rows.join(ids, same, "left_semi").withColumn(flag, before + bit)
    return inside.unionByName(rows.join(ids, same, "left_anti").withColumn(flag, before))


def _orders(classes: DataFrame, names: list[str], labels: list[str]) -> DataFrame:
    """All orders' steps from the number of documents per part, class and label."""
    everything = (1 << len(names)) - 1
    steps = [(place, before) for place in range(len(names)) for before in range(everything + 1)
             if not before >> place & 1]
    # Orders in which exactly these filters come before this one.
    weight = {(p, b): math.factorial(b.bit_count()) * math.factorial(len(names) - 1 - b.bit_count()) for p, b in steps}
    spark = classes.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.lit(b).alias("before"), F.lit(weight[p, b]).alias("times"))
                               for p, b in steps])).alias("s")
    met = classes.select("*", each).select("*", "s.*").drop("s")
    own = F.expr("shiftleft(1, place)")
    fails_own = F.col("fails").bitwiseAND(own) != 0
    gone_before = F.col("fails").bitwiseAND(F.col("before")) != 0
    removed = fails_own & ~gone_before

    def total(condition: Column, of: Column = F.col("n")) -> Column:
        return F.coalesce(F.sum(F.when(condition, of)), F.lit(0)).cast("long")

    found = met.groupBy("part", "place", "before").agg(
        total(~fails_own & ~gone_before).alias("kept"), total(removed).alias("removed"),
        total(fails_own & gone_before).alias("redundant"),
        total(F.col("fails") == own).alias("unique_fails"),
        *[total(removed & (F.col(label) > 0)).alias(label) for label in labels],
        total(removed, F.col("n") * F.col("times")).alias("share"))
    values = found.groupBy("part", "place").agg(F.sum("share").alias("shapley"))
    # Fixed numbers of rows: the orders of at most MAX_FILTERS filters.
    at = {name: i for i, name in enumerate(names)}
    orders = spark.createDataFrame(
        [("".join(order), step + 1, at[name], sum(1 << at[n] for n in order[:step]))
         for order in itertools.permutations(names) for step, name in enumerate(order)],
        "filter_order string, step int, place int, before int")
    return (found.drop("share").join(F.broadcast(orders), ["place", "before"]).join(values, ["part", "place"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *labels, "shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The audit of documents by five filters: A to D judge a text alone (``text_filters``), E texts that a
    smaller id has too, removed or not.

    Null texts count as empty, null sources as the empty part. ``labels`` (doc_id, quality, toxic) may
    miss documents or repeat them: a document is good or toxic if any of its labels says so. Repeated
    rows each count; an empty table gives an empty result.
    """
    facts = stage(document_facts(docs), "facts")
    names = list(text_filters(F.col("text")))
    # One table of ids per filter.
    failing = {name: stage(facts.where(name).select("doc_id", "digest"), f"failing-{name}") for name in names}
    failing["E"] = stage(repeated_texts(facts, hot_rows), "failing-E")
    return audit(facts, failing, {"good_lost": labels.where("quality = 1").select("doc_id"),
                                  "toxic_lost": labels.where("toxic = 1").select("doc_id")}, ["doc_id", "digest"])
