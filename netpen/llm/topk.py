"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets, so that those of a bucket have similar lengths. For
a query whose k-th best score so far is t, a vector of a bucket can only matter if its cosine with the
query reaches t / (query length * bucket's largest length), the bucket's local threshold: above 1 the
whole bucket is passed over; else the bucket's vectors are pruned by their own lengths, or, where the
threshold is high, by the range that a large coordinate of the query leaves for theirs. What is left is
verified by its exact integer product.

First every block of queries meets the bucket of the longest vectors, which gives each query a first
t; then it meets the other buckets. Blocks and buckets are bounded in rows, whatever lengths or values
repeat; each pair of a block and a bucket is a small group of its own and returns k rows per query
at most, cut by the same t. A query set against all rows in blocks has as many pairs as it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from netpen.llm.common import width
from netpen.session import stage

SCALE = 64
BUCKET_ROWS = 4096
QUERY_ROWS = 1024
COORDINATE_THRESHOLD = 0.7  # local thresholds from which coordinates prune


def quantise(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding",
             scale: int = SCALE) -> DataFrame:
    """``id`` and ``v``, an array of longs: floor(scale * x) per component.

    Null vectors and those with a null or non-finite component are left out.
    """
    x = F.col(f"`{column}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (
        F.abs(c) < F.lit(float("inf"))))
    return vectors.where(fine).select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors by inner product.

    Both tables have ``id`` and ``v`` as from ``quantise``. Equal scores go to the smaller vec_id. A vector
    with the query's own id is no candidate; rows of null id take part neither way. Repeated rows are
    candidates each. Vectors of different dimensions are compared over their common components.
    Products are exact as long as they fit 64 bits. A query without candidates has no rows.
    """
    rows = vectors.where("id is not null").select("id", "v", _norm().alias("norm"))
    buckets = stage(_blocks(rows.withColumn("by", -F.col("norm")), BUCKET_ROWS), "buckets")
    blocks = stage(_blocks(queries.where("id is not null").select(
        "id", "v", _norm().alias("norm"), F.xxhash64("id").cast("double").alias("by")), QUERY_ROWS), "query-blocks")
    lengths = stage(buckets.select("block", F.array_max("norms").alias("longest")), "bucket-lengths")
    sizes = blocks.select(F.col("block").alias("q"), F.lit(None).cast("array<bigint>").alias("floors"))
    first = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(0))))  # the longest vectors
    start = stage(_search(blocks, buckets, first, k), "first-scores")
    # Each query's score to reach: its k-th best so far; null while it has fewer.
    reach = start.groupBy("q", "at").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(
        F.col("n") == k).select("q", "at", "floor")
    members = blocks.select(F.col("block").alias("q"), F.posexplode("norms").alias("at", "norm")).join(
        reach, ["q", "at"], "left")
    # No vector shorter than the least floor / length can matter to a block.
    known = stage(members.groupBy("q").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "floor"))), lambda x: x["floor"]).alias("floors"),
        F.min(F.when(F.col("floor") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(0.0))).alias("least")),
        "query-floors")
    last = lengths.agg(F.max("block")).first()[0] or 0
    others = F.sequence(F.lit(1), F.lit(last)) if last else F.array().cast("array<int>")
    pairs = known.withColumn("block", F.explode(others)).join(lengths, "block").where(
        F.col("least") <= F.col("longest") * (1 + 1e-9))
    found = start.unionByName(_search(blocks, buckets, pairs.select("q", "block", "floors"), k))
    best = Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _norm():
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows in the order of ``by``, packed into blocks of at most ``size`` rows, numbered from 0.

    Sorted by ranges of (by, id); only the ranges' row counts reach the driver.
    """
    ranges = stage(rows.repartitionByRange(width(rows), "by", "id", F.xxhash64("v"))
                   .sortWithinPartitions("by", "id")
                   .withColumn("part", F.spark_partition_id())
                   .withColumn("place", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    counts = sorted(ranges.groupBy("part").count().collect())
    before, starts = 0, []
    for row in counts:
        starts += [F.lit(row["part"]), F.lit(before)]
        before += -(-row["count"] // size)
    start = F.create_map(*starts)[F.col("part")] if starts else F.lit(0)
    # Members come as a sorted list of at most ``size`` rows.
    return ranges.withColumn("block", (start + F.floor(F.col("place") / size)).cast("int")).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "v", "norm"))).alias("m")).select(
        "block", F.col("m.id").alias("ids"), F.col("m.v").alias("vs"), F.col("m.norm").alias("norms"))


def _search(blocks: DataFrame, buckets: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The candidates that each pair of a query block ``q`` and a bucket ``block`` yields."""
    left = pairs.join(blocks.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"),
                                    F.col("vs").alias("q_vs")), "q").select("q", "block", "floors", "q_ids", "q_vs")
    right = pairs.select(F.col("q").alias("of_q"), "block").join(buckets, "block").select(
        "of_q", F.col("block").alias("of_block"), "ids", "vs")
    return left.groupBy("q", "block").cogroup(right.groupBy("of_q", "of_block")).applyInArrow(
        lambda a, b: _scores(a, b, k), "q int, at int, query_id long, vec_id long, score long")


def _matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dimension), np.int64)
    flat = lists.flatten().to_numpy()
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = flat
    return out


def _scores(block: pa.Table, bucket: pa.Table, k: int) -> pa.Table:
    names, kinds = ["q", "at", "query_id", "vec_id", "score"], [pa.int32()] * 2 + [pa.int64()] * 3
    if not len(block) or not len(bucket):  # there is no such bucket
        return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
    floors, q_ids, q_vs = (block.column(c)[0].values for c in ("floors", "q_ids", "q_vs"))
    ids, vs = (bucket.column(c)[0].values for c in ("ids", "vs"))
    wide = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in (q_vs, vs))
    floor = [None] * len(q_ids) if floors is None else floors.to_pylist()
    at, vec_ids, scores = _bucket(q_ids.to_numpy(), _matrix(q_vs, wide), floor, ids.to_numpy(),
                                  _matrix(vs, wide), k)
    q = np.full(len(at), block.column("q")[0].as_py())
    values = [q, at, q_ids.to_numpy()[at], vec_ids, scores]
    return pa.table({n: pa.array(v, t) for n, t, v in zip(names, kinds, values)})


def _bucket(q_ids, queries, floors, ids, vectors, k: int):
    """Each query's best k of the bucket; the bucket's vectors come longest first."""
    as_float, q_float = vectors.astype(np.float64), queries.astype(np.float64)
    norms = np.sqrt((as_float ** 2).sum(axis=1))
    q_norms = np.sqrt((q_float ** 2).sum(axis=1))
    longest = norms.max(initial=0.0)
    # Sums of products below 2**53 are exact as doubles.
    exact = np.abs(as_float).max(initial=0) * np.abs(q_float).max(initial=0) * vectors.shape[1] < 2 ** 53
    slack = 1e-9  # pruning bounds are doubles: keep what is on their edge
    out_q, out_v, out_s = [], [], []
    # Coordinates in order of value, for those queries that prune by one.
    sorted_columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(q_ids)):
        floor = floors[i]
        chosen = None
        if floor is not None and floor > 0:
            reach = q_norms[i] * longest
            local = floor / reach if reach else np.inf
            if local > 1 + slack:
                continue
            # Length pruning: a prefix, since the longest come first.
            prefix = int(np.searchsorted(-norms, -(floor / q_norms[i]) * (1 - slack), side="right"))
            chosen = np.arange(prefix)
            if local >= COORDINATE_THRESHOLD:
                # With cosine c or more, a unit vector's coordinate is at least
                # c*q - sqrt(1-c^2)*sqrt(1-q^2) for the query's unit coordinate q; the largest q is best.
                axis = int(np.argmax(np.abs(q_float[i])))
                q = abs(q_float[i, axis]) / q_norms[i]
                c = min(local, 1.0)
                low = c * q - np.sqrt(max(0.0, 1 - c * c)) * np.sqrt(max(0.0, 1 - q * q)) - slack
                if axis not in sorted_columns:
                    unit = as_float[:, axis] / np.where(norms == 0, 1, norms)
                    order = np.argsort(unit)
                    sorted_columns[axis] = order, unit[order]
                order, values = sorted_columns[axis]
                part = order[np.searchsorted(values, low):] if q_float[i, axis] > 0 else (
                    order[:np.searchsorted(values, -low, side="right")])
                chosen = part[part < prefix]
        some = vectors if chosen is None else vectors[chosen]
        if exact:
            scores = (as_float if chosen is None else as_float[chosen]) @ q_float[i]
            scores = scores.astype(np.int64)
        else:
            scores = some @ queries[i]
        own_ids = ids if chosen is None else ids[chosen]
        fits = own_ids != q_ids[i]
        if floor is not None:
            fits &= scores >= floor
        scores, own_ids = scores[fits], own_ids[fits]
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= edge
            scores, own_ids = scores[near], own_ids[near]
        order = np.lexsort((own_ids, -scores))[:k]
        out_q.append(np.full(len(order), i)), out_v.append(own_ids[order]), out_s.append(scores[order])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_v), join(out_s)
