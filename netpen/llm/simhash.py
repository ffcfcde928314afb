"""SimHash near-duplicates by a range join of per-segment bit counts.

A fingerprint is cut into 32 segments of two bits; their bit counts form a point with 32 coordinates
from 0 to 2. The Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints. Written in unary (0, 1, 2 as 00, 01, 11) the point is one 64-bit number, and the
Manhattan distance is the number of differing bits of two such numbers.

Range join: the segments are dealt into ``PARTS`` parts. Points within distance r differ in at most r
parts, so they agree on ``PARTS - r`` of them at least and meet in a cell of one of the grids, each of
which spans that many parts. Within a cell, pairs are tested by Manhattan distance, then exactly.

Only distinct fingerprints are joined. A cell with more than ``BLOCK`` of them is dealt into blocks, and
each pair of blocks becomes a cell of its own, so no task holds a large cell. What leaves a cell is a
star per group it connects, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netpen.llm.common import width
from netpen.llm.components import components
from netpen.session import stage

PARTS = 7
BLOCK = 2048
EVEN = 0x5555555555555555


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4,
                 out: str = "simhash") -> DataFrame:
    """The input with ``out``: the 64-bit SimHash (a long) of each text's word shingles.

    A-Z count as a-z; words are runs without ASCII white space; a shingle is ``shingle`` words joined by
    a space, fewer words are one shingle; repeats count. A bit is set if it is set in more than half
    of the shingles' XXH64 (seed 42). Null texts and texts without words give 0.
    """
    if out in docs.columns:
        raise ValueError(f"a column is already named {out}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text}`").cast("binary").alias("bytes"))
    schema = T.StructType([rows.schema["row"], T.StructField("simhash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(b.as_py() or b"", shingle) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["row", "simhash"])

    return rows.mapInArrow(run, schema).select("row.*", F.col("simhash").alias(out))


_BITS = np.array([[(byte >> bit) & 1 for bit in range(8)] for byte in range(256)])
_POWERS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # of bytes: both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:max(1, len(words) - shingle + 1)].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)),
                         np.uint64, len(starts))
    # How often each byte value stands at each of the eight places, then how often each bit is set.
    placed = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
    set_bits = (np.bincount(placed.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(_POWERS[2 * set_bits > len(hashes)].sum())


def embed(fingerprint_column: Column) -> Column:
    """The point of bit counts in unary, as a long."""
    x, half = fingerprint_column, F.shiftrightunsigned(fingerprint_column, 1)
    even = F.lit(EVEN)
    return x.bitwiseOR(half).bitwiseAND(even).bitwiseOR(
        F.shiftleft(x.bitwiseAND(half).bitwiseAND(even), 1))


def _embed(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(EVEN), np.uint64(1)
    return ((x | x >> one) & even) | ((x & x >> one & even) << one)


def grids(distance: int, parts: int) -> list[int]:
    """The bit mask of each grid; as signed numbers, as Spark has them."""
    dealt = [0] * parts
    for segment in range(32):
        dealt[segment * parts // 32] |= 3 << 2 * segment
    masks = [sum(dealt[i] for i in chosen) for chosen in combinations(range(parts), parts - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def link_groups(prints: DataFrame, column: str = "simhash", distance: int = 4, parts: int = PARTS,
                block: int = BLOCK) -> DataFrame:
    """``node`` and ``root`` for each fingerprint that links to a smaller one, directly or over others.

    ``root`` is the smallest fingerprint of the group as a signed long; it has no row of its own. Nulls
    take no part.
    """
    if distance >= parts:
        raise ValueError("more parts than differing bits are needed")
    points = stage(prints.select(F.col(f"`{column}`").alias("fp")).where("fp is not null").distinct(),
                   "fingerprints")
    cells = points.select("fp", embed(F.col("fp")).alias("point")).select("fp", F.posexplode(F.array(
        *[F.col("point").bitwiseAND(F.lit(m)) for m in grids(distance, parts)])).alias("grid", "cell"))
    large = stage(cells.groupBy("grid", "cell").count().where(F.col("count") > block)
                  .select("grid", "cell", F.ceil(F.col("count") / block).cast("int").alias("n")),
                  "large-cells")
    # A block meets each block of its cell, itself included, once.
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    split = cells.join(large, ["grid", "cell"]).select(
        "fp", "grid", "cell", "n", mine.alias("mine"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "fp", "grid", "cell", (F.least("mine", "other") * F.col("n") + F.greatest("mine", "other") + 1)
        .cast("long").alias("pair"))
    whole = cells.join(large, ["grid", "cell"], "left_anti").select(
        "fp", "grid", "cell", F.lit(0).cast("long").alias("pair"))
    key = ["grid", "cell", "pair"]
    dealt = whole.unionByName(split).repartition(width(prints), *key).sortWithinPartitions(*key)
    links = dealt.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")
    return components(links)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links within cells; rows come sorted by cell, and a cell may continue in the next batch."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
        rows = np.concatenate([*held, rows], axis=1) if held else rows
        change = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        held = [rows[:, cut:]]
        if cut:
            yield from _found(rows[:, :cut], distance)
    if held:
        yield from _found(held[0], distance)


def _found(rows: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    if not rows.shape[1]:
        return
    prints = rows[0].view(np.uint64)
    starts = np.concatenate([[0], np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0)) + 1])
    sizes = np.diff(np.append(starts, rows.shape[1]))
    points = _embed(prints)
    left, right = [], []
    # Small cells: compare each row with the k-th after it, all cells at once.
    small = 8
    tail = np.repeat(starts + sizes, sizes) - np.arange(rows.shape[1]) - 1  # rows after this one
    tail[np.repeat(sizes > small, sizes)] = 0
    for k in range(1, small):
        i = np.flatnonzero(tail >= k)
        i = i[np.bitwise_count(points[i] ^ points[i + k]) <= distance]
        i = i[np.bitwise_count(prints[i] ^ prints[i + k]) <= distance]
        left.append(prints[i]), right.append(prints[i + k])
    for start, size in zip(starts[sizes > small], sizes[sizes > small]):
        for group in _groups(prints[start:start + size], points[start:start + size], distance):
            left.append(group[1:]), right.append(np.full(len(group) - 1, group[0]))
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _groups(prints: np.ndarray, points: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """The connected groups of two or more, each sought outward from its first member."""
    open_prints, open_points = prints, points
    while len(open_prints):
        group = [(open_prints[0], open_points[0])]
        open_prints, open_points = open_prints[1:], open_points[1:]
        at = 0
        while at < len(group) and len(open_prints):
            near = np.bitwise_count(open_points ^ group[at][1]) <= distance
            near[near] = np.bitwise_count(open_prints[near] ^ group[at][0]) <= distance
            if near.any():
                group += zip(open_prints[near], open_points[near])
                open_prints, open_points = open_prints[~near], open_points[~near]
            at += 1
        if len(group) > 1:
            yield np.sort(np.array([p for p, _ in group], np.uint64).view(np.int64)).view(np.uint64)


def _classes(rows: DataFrame, id_column: str, distance: int) -> DataFrame:
    """``simhash``, ``root`` and ``component_id`` for each distinct fingerprint of ``rows``."""
    own = stage(rows.groupBy("simhash").agg(F.min(id_column).alias("first")), "print-ids")
    roots = link_groups(own, "simhash", distance)
    members = stage(own.join(roots, own["simhash"] == roots["node"], "left").select(
        "simhash", "first", F.coalesce("root", "simhash").alias("root")), "print-roots")
    least = stage(members.groupBy("root").agg(F.min("first").alias("component_id")), "root-ids")
    return stage(members.join(least, "root").select("simhash", "root", "component_id"), "print-classes")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    distance: int = 4) -> DataFrame:
    """The input's other columns with ``simhash`` and ``component_id`` for every row.

    ``component_id`` is the smallest id whose fingerprint is reachable over links of at most
    ``distance`` differing bits, the row's own included. Null ids are passed over; a group without any
    id has a null component. Rows with equal ids or texts all stay. An empty table gives an empty one.
    """
    if "component_id" in docs.columns:
        raise ValueError("a column is already named component_id")
    rows = stage(fingerprints(docs, text).drop(text), "simhash")
    return rows.join(_classes(rows, id_column, distance).drop("root"), "simhash")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                  distance: int = 4) -> DataFrame:
    """The input's rows, one per group of near duplicates: that with the smallest id, null ids last.

    Of rows with equal ids in one group, one stays. An empty table gives an empty one.
    """
    # The inputs sit in a struct: their names clash with nothing here.
    rows = fingerprints(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                    F.col(f"`{text}`").alias("text")), "text")
    rows = stage(rows.select("row", F.col("row")[id_column].alias("id"), "simhash",
                             F.monotonically_increasing_id().alias("place")), "simhash-rows")
    light = rows.select("id", "simhash", "place")
    placed = light.join(_classes(light, "id", distance), "simhash")
    first = stage(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "place"))["place"]
                                             .alias("place")), "simhash-kept")
    return rows.join(first.hint("shuffle_hash"), "place", "left_semi").select("row.*")
