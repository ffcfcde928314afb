import random
import re

import pytest

from netpen.llm import mixing


def size(text):
    return len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])


def goals(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows(texts):
    pick = random.Random(2)
    more = [(1000 + i, " ".join(["w"] * pick.randrange(0, 60)), pick.choice(["b", "é", "a", "zz", None, "one"]))
            for i in range(300)]
    return [(i, t, "b") for i, t in texts] + more + [(2000, "only one text", "single"), (2001, None, "empty")]


def test_targets_and_amounts(llm, texts):
    data = rows(texts)
    docs = llm.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted([(r.doc_id, r.source, r["size"]) for r in got], key=repr) == sorted(
        [(i, s, size(t)) for i, t, s in data], key=repr)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = goals(sizes)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    # Whole epochs come first: within a source amounts differ by one epoch at most.
    for s in sizes:
        some = {r.taken // r["size"] for r in got if r.source == s and r["size"]}
        assert not some or max(some) - min(some) <= 1


def test_better_texts_come_first(llm):
    good, bad = "plain words only " * 5, "%%% ### $$$ @@@ " * 4
    data = [(i, good if i % 2 else bad, "s") for i in range(2000)]
    docs = llm.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.3, most=2.0).collect()
    share = [sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[1] > 2 * share[0] > 0


def test_spread(llm, texts):
    docs = llm.createDataFrame(rows(texts), "doc_id long, text string, source string")
    mixed = mixing.mix(docs, keep=docs.columns).collect()
    got = {}
    for r in mixing.spread(mixing.mix(docs, keep=docs.columns)).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + size(r.text)
    want = {}
    for r in mixed:
        if r.taken:
            want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    assert got == want


def test_empty_tables(llm):
    docs = llm.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert [r.taken for r in mixing.mix(llm.createDataFrame([(1, None, None)], docs.schema)).collect()] == [0]
