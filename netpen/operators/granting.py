"""Requests for time on a shared resource, granted one by one in request order.

A request is granted when no granted earlier one meets it: none of the same key has its time, none
holds its unique number. What was refused blocks nobody. That is a fold over all requests, and the folds
of different keys hang together through the numbers; it is settled in rounds instead. Each round cuts the
open requests into pieces (a key, or a stretch of a hot key's time between quantiles of the starts) and
takes each piece in request order with three answers:

* refused, if it meets a granted request of the piece;
* unknown, if an earlier request that is unknown itself meets it, or if it reaches into other pieces
  or has an earlier rival for its number: then others must be heard;
* granted, otherwise.

A request that is unknown only because of other pieces is granted once all its pieces are ready for it. The
first open request of all is always settled, so rounds end; all that does not hang together across
pieces is settled in the first. No pair of requests is ever formed.
"""

from __future__ import annotations

import bisect
import functools

from pyspark.sql import DataFrame, functions as F

from netpen.operators.hot import hot_keys, is_hot
from netpen.operators.latest import first_per_key
from netpen.session import release, stage

PIECE_ROWS = 20_000  # starts per piece of a hot key

GRANTED, REFUSED, UNKNOWN, READY = 2, 1, 0, -1


class _Spans:
    """Disjoint spans in order; what touches is merged."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start

    def add(self, start: int, end: int) -> None:
        first = bisect.bisect_left(self.ends, start)
        last = bisect.bisect_right(self.starts, end)
        if first < last:
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [start], [end]


def _settle(piece):
    """One round's answers of a piece, in request order; rows granted before come first."""
    piece = piece.sort_values(["settled", "request"], ascending=[False, True], kind="stable")
    granted, unknown, answers = _Spans(), _Spans(), []
    for settled, start, end, apart in zip(piece["settled"].tolist(), piece["from"].tolist(), piece["upto"].tolist(),
                                          piece["apart"].tolist()):
        if settled:
            answer = GRANTED
        elif granted.meets(start, end):
            answer = REFUSED
        elif unknown.meets(start, end):
            answer = UNKNOWN
        else:
            answer = READY if apart else GRANTED
        if answer == GRANTED:
            granted.add(start, end)
        elif answer != REFUSED:
            unknown.add(start, end)
        answers.append(answer)
    return piece[["request"]].assign(answer=answers)


def grant_spans(requests: DataFrame, key: str, start: str, end: str, order: str, number: str | None = None,
                hot_rows: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``order`` and ``verdict`` of each request: granted, meets_granted or number_granted.

    ``start`` and ``end`` are timestamps of half-open spans, which must not be empty; ``order`` is a whole
    number that tells requests apart. Of the two refusals a taken number comes first. Spans of different
    keys never meet; requests without a key meet each other. Requests without a number have no rival.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    given = F.col(number).cast("string") if number else F.lit(None).cast("string")
    left = stage(requests.select(
        F.col(order).cast("long").alias("request"), F.col(key).cast("string").alias("key"),
        micros(start).alias("from"), micros(end).alias("upto"), given.alias("number"), F.lit(False).alias("settled")),
        "requests")
    verdicts: list[DataFrame] = []
    held = left.limit(0)
    while True:
        pieces = _pieces(left, held, number is not None, hot_rows, piece_rows)
        heard = pieces.groupBy("key", "piece").applyInPandas(_settle, "request long, answer int").groupBy("request").agg(
            F.max("answer").alias("most"), F.min("answer").alias("least"))
        # Refused by one piece is refused; granted needs all pieces, as far as they know of others.
        answer = F.when(F.col("most") == REFUSED, "meets_granted").when(
            (F.col("most") == GRANTED) | ((F.col("least") == READY) & (F.col("most") == READY) & F.col("first")), "granted")
        judged = stage(left.join(_first(left, number is not None), "request").join(heard, "request")
                       .withColumn("verdict", answer).drop("most", "least", "first"), "judged-requests")
        release(left)
        left, done = judged.where("verdict is null").drop("verdict"), judged.where("verdict is not null")
        if number:
            # Who asks for a number that is granted now is refused, whatever else it meets.
            marked = stage(judged.join(_holders(judged), "number", "left").withColumn("verdict", F.when(
                F.col("verdict").isNull() & (F.col("holder") < F.col("request")), "number_granted").otherwise(
                F.col("verdict"))).drop("holder"), "rival-requests")
            release(judged)
            left, done = marked.where("verdict is null").drop("verdict"), marked.where("verdict is not null")
        verdicts.append(done.select("request", "number", "verdict"))
        if left.isEmpty():
            out = functools.reduce(DataFrame.unionByName, verdicts)
            if number:
                # The number is looked at first, also where its holder was settled after the refusal.
                out = out.join(_holders(out), "number", "left").withColumn("verdict", F.when(
                    F.col("holder") < F.col("request"), "number_granted").otherwise(F.col("verdict")))
            return out.select(F.col("request").alias(order), "verdict")
        held = held.unionByName(done.where("verdict = 'granted'").drop("verdict").withColumn("settled", F.lit(True)))
        left = stage(left.select(*held.columns), "open-requests")


def _holders(judged: DataFrame) -> DataFrame:
    """``number`` and ``holder``, the request that it was granted to."""
    return judged.where("verdict = 'granted' and number is not null").select("number", F.col("request").alias("holder"))


def _first(left: DataFrame, numbered: bool) -> DataFrame:
    """``request`` and ``first``: no open request before it asks for the same number."""
    if not numbered:
        return left.select("request", F.lit(True).alias("first"))
    return first_per_key(left.select("request", "number"), ["number"], ["request"], "first").select(
        "request", (F.col("first") | F.col("number").isNull()).alias("first"))


def _pieces(left: DataFrame, held: DataFrame, numbered: bool, hot_rows: int | None, piece_rows: int) -> DataFrame:
    """Open requests and those granted before, once per piece that they reach into."""
    every = left.join(_first(left, numbered), "request").unionByName(held.withColumn("first", F.lit(True)))
    hot = hot_keys(left, ["key"], piece_rows if hot_rows is None else hot_rows)
    if not hot:
        return every.select("request", "key", "from", "upto", "settled", (~F.col("first")).alias("apart"),
                            F.lit(0).alias("piece"))
    marked = every.withColumn("hot", is_hot(["key"], hot))
    # As many quantiles of the starts as the heaviest key has pieces: bounded by its rows over the piece's.
    heaviest = left.groupBy("key").count().agg(F.max("count")).first()[0]
    parts = max(2, -(-heaviest // (piece_rows if hot_rows is None else hot_rows)))
    cuts = marked.where("hot").groupBy("key").agg(F.percentile_approx(
        "from", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("cuts"))
    # One row per hot key: fewer than the rows over the threshold.
    met = marked.join(F.broadcast(cuts), F.col("hot") & marked["key"].eqNullSafe(cuts["key"]), "left").drop(cuts["key"])
    below = lambda at, strict: F.size(F.filter(
        F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: (c < at) if strict else (c <= at)))
    reach = F.sequence(below(F.col("from"), False), F.greatest(below(F.col("upto"), True), below(F.col("from"), False)))
    return met.select(
        "request", "key", "from", "upto", "settled", (~F.col("first") | (F.size(reach) > 1)).alias("apart"),
        F.explode(reach).alias("piece"))
