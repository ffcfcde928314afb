"""The audit against plain loops over every order."""

import itertools
import random
import re

import pytest

from netpen.llm import filter_audit, queries


def plain_fails(rows):
    """Per row the set of filters it fails."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and i > first[text]:
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels):
    fails = plain_fails(rows)
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(name in f for _, f in docs) - len(gone), sum(f == {name} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    values = {}
    for (part, order, step), row in out.items():
        values[part, order[step - 1]] = values.get((part, order[step - 1]), 0) + row[1]
    return {(*k, *row, values[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def corpus():
    pick = random.Random(4)
    rows = []
    for i in range(300):
        vocabulary = [f"w{j}" for j in range(pick.choice([5, 60, 400]))]
        text = " ".join(pick.choice(vocabulary) for _ in range(pick.choice([3, 49, 50, 120])))
        if pick.random() < .3:
            text = text.upper() if pick.random() < .5 else text + " #|"
        if rows and pick.random() < .3:
            text = pick.choice(rows)[1]
        rows.append((i, text, pick.choice(["hot"] * 4 + ["x", "y", None, ""])))
    rows += [(None, rows[3][1], "x"), (None, None, None), (400, None, "x"), (401, "", "x"), (402, " \t ", "only"),
             (5, rows[9][1], "y"), rows[7], rows[7], (403, "\u00c9A" * 60, "y"), (404, "long " * 30000, "y")]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 420, 2)]
    return rows, labels + [(None, 1, 1), (7, 1, 1), (7, 0, 0), (7, 1, 1)]


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_equals_loops(llm, hot_rows):
    rows, labels = corpus()
    docs = llm.createDataFrame([(i, t, s, 0, 1) for i, t, s in rows],
                               "doc_id long, text string, source string, part int, A int")
    marks = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs, marks, hot_rows)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, labels)


def test_empty_tables(llm, tmp_path):
    rows, labels = corpus()
    for name, some, kind in (("documents", [], "doc_id long, text string, source string"),
                             ("labels", [], "doc_id long, quality int, toxic int")):
        llm.createDataFrame(some, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert queries.op13_filters(llm, str(tmp_path)).count() == 0
    docs = llm.createDataFrame(rows[:5], "doc_id long, text string, source string")
    found = filter_audit.audit_documents(docs, llm.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    assert {tuple(r) for r in found} == brute(rows[:5], [])


def test_other_filters(llm):
    facts = llm.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (3, "q")], "id int, part string")
    ids = lambda *some: llm.createDataFrame([(i,) for i in some], "id int")
    got = {tuple(r) for r in filter_audit.audit(facts, {"x": ids(1, 3, 3), "y": ids(1)}, {"lost": ids(3, 9)}, ["id"]).collect()}
    assert got == {("p", "xy", 1, 1, 1, 0, 0, 0, 1), ("p", "xy", 2, 1, 0, 1, 0, 0, 1),
                   ("p", "yx", 1, 1, 1, 0, 0, 0, 1), ("p", "yx", 2, 1, 0, 1, 0, 0, 1),
                   ("q", "xy", 1, 0, 2, 0, 2, 2, 4), ("q", "xy", 2, 0, 0, 0, 0, 0, 0),
                   ("q", "yx", 1, 2, 0, 0, 0, 0, 0), ("q", "yx", 2, 0, 2, 0, 2, 2, 4)}
    with pytest.raises(ValueError):
        filter_audit.audit(facts, {}, {}, ["id"])
