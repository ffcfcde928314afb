import math
import random

import pytest

from netpen.llm import topk


def brute(rows, k):
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, k):
    table = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return sorted(tuple(r) for r in topk.top_k(table.where("id % 5 = 0"), table, k).select(
        "query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_against_brute_force(llm, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    pick = random.Random(1)
    axes = [[pick.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(220):
        scale = math.exp(pick.gauss(0, spread))
        base = pick.choice(axes)
        rows.append((i, [float(f"{scale * (b + pick.gauss(0, 0.2)):.3f}") for b in base]))
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # one common vector, with ties
    rows += [(400, None), (405, [1.0, None]), (410, [float("nan")] * 8), (415, [float("inf")] * 8), (420, [0.0] * 8),
             (425, [-1.0] * 8)]
    llm_rows = [(i, v) for i, v in rows]
    import numpy as np
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(llm, llm_rows, 7) == brute(exact, 7)


def test_few_and_no_rows(llm):
    assert run(llm, [], 20) == []
    assert run(llm, [(5, [1.0])], 20) == []
    assert run(llm, [(5, [1.0]), (6, [2.0])], 20) == [(5, 1, 6, 64 * 128)]
