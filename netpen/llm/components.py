"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netpen.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node that reaches a smaller one.

    Nodes are longs. Links may repeat, point either way or to themselves; links with a null end are
    ignored; an empty table gives an empty one. Each round links every node's larger neighbours to
    its smallest (large star), then all its smaller ones (small star), and is written out, which cuts
    the lineage. Nothing but a count and a checksum of the links reaches the driver. The smallest
    neighbours are written before they are joined, so that both sides of each join are plain
    shuffles, which AQE splits where a node has very many links.
    """
    edges = _tidy(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    edges = stage(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.select(F.inline(F.array(F.struct("u", "v"),
                                             F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"))
                      .select("u", F.least("u", "m").alias("m")), "least")
        large = stage(_tidy(both.join(least, "u").where(F.col("v") > F.col("u"))
                            .select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        edges = stage(_tidy(large.join(least, "u").select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))),
            "small-star")


def _tidy(edges: DataFrame) -> DataFrame:
    """Links from the larger node to the smaller, once each."""
    return edges.where(F.col("u") != F.col("v")).distinct()
