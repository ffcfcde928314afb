"""Granting in request order against one request after the other."""

import datetime as dt
import random

import pytest

from netpen.operators import granting
from netpen.plans.register import register

ZERO = dt.datetime(2024, 1, 1)


def one_by_one(rows):
    taken, numbers, out = {}, set(), {}
    for request, key, start, end, number in sorted(rows):
        if number is not None and number in numbers:
            out[request] = "number_granted"
        elif any(s < end and start < e for s, e in taken.get(key, [])):
            out[request] = "meets_granted"
        else:
            out[request] = "granted"
            taken.setdefault(key, []).append((start, end))
            numbers.add(number)
    return out


def dense(seed, n, keys, span, longest):
    pick = random.Random(seed)
    rows = []
    for i in pick.sample(range(10 * n), n):
        start = pick.randrange(span)
        length = pick.randrange(1, longest) if pick.random() < 0.97 else pick.randrange(1, span)
        rows.append((i, pick.choice(keys), ZERO + dt.timedelta(minutes=start), ZERO + dt.timedelta(minutes=start + length),
                     pick.choice([None, f"T{pick.randrange(n)}", f"T{pick.randrange(3)}"])))
    return rows


def granted(spark, rows, numbered=True, **more):
    frame = spark.createDataFrame(rows, "request_id long, cage string, s timestamp_ntz, e timestamp_ntz, no string")
    got = granting.grant_spans(frame, "cage", "s", "e", "request_id", "no" if numbered else None, **more).collect()
    assert len(got) == len(rows)
    return {r.request_id: r.verdict for r in got}


@pytest.mark.parametrize("seed, n, keys, span, longest, more", [
    (1, 400, ["a", "b", "c", None], 3000, 90, {}), (2, 500, ["hot", "hot", "hot", "b"], 2000, 60, {"hot_rows": 40}),
    (3, 300, ["hot"], 400, 30, {"hot_rows": 25}), (4, 200, ["a", "b"], 60, 50, {"hot_rows": 10})])
def test_random_requests_equal_a_loop(spark, seed, n, keys, span, longest, more):
    rows = dense(seed, n, keys, span, longest)
    assert granted(spark, rows, **more) == one_by_one(rows)
    bare = [(*r[:4], None) for r in rows]
    assert granted(spark, bare, False, **more) == one_by_one(bare)


def test_a_chain_in_order_of_time(spark):
    """Each request meets the one before: every other one is granted, within one piece and over several."""
    rows = [(i, "a", ZERO + dt.timedelta(minutes=10 * i), ZERO + dt.timedelta(minutes=10 * i + 15), None) for i in range(200)]
    want = one_by_one(rows)
    assert granted(spark, rows, False) == want and list(want.values()).count("granted") == 100
    assert granted(spark, rows, False, hot_rows=70) == want


def test_nothing_asked(spark):
    assert granted(spark, []) == {}


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_tides_are_registered_in_request_order(spark, hot_rows):
    rows = dense(7, 250, ["C1", "C2", "C9"], 2500, 80)
    stored = [("T1", "C1", ZERO, ZERO + dt.timedelta(minutes=200))]
    tables = {
        "tide_session": spark.createDataFrame(stored, "tide_no string, cage_no string, start_at_utc timestamp_ntz, end_at_utc timestamp_ntz"),
        "cage_sea_area": spark.createDataFrame([("C1", "north", "UTC"), ("C2", "south", "Asia/Shanghai")],
                                               "cage_no string, sea_area string, time_zone string")}
    asked = [(i, no or f"N{i}", c, s, e) for i, c, s, e, no in rows] + [(90_000, "N-x", "C1", ZERO, ZERO), (90_001, "T1", "C2", ZERO, ZERO)]
    found = register("tide_session", spark.createDataFrame(
        asked, "request_id long, tide_no string, cage_no string, start_at_utc timestamp_ntz, end_at_utc timestamp_ntz"), tables, hot_rows)
    taken, numbers, want = {"C1": [stored[0][2:]]}, {"T1"}, {}
    for i, no, cage, start, end in sorted(asked):
        want[i] = ("key_exists" if no in numbers else "start_not_before_end" if start >= end else
                   "no_sea_area" if cage == "C9" else
                   "overlaps_tide" if any(s < end and start < e for s, e in taken.get(cage, [])) else None)
        if want[i] is None:
            taken.setdefault(cage, []).append((start, end))
            numbers.add(no)
    got = {r.request_id: r.reason for r in found.rejected.collect()} | {r.request_id: None for r in found.accepted.collect()}
    assert got == want
