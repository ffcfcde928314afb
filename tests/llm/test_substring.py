import random
import re

from netpen.llm import substring


def brute(rows, window):
    words = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    seen = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i:i + window])] = seen.get(tuple(ws[i:i + window]), 0) + 1
    out = []
    for (key, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, window):
    docs = spark.createDataFrame([(k, t, "p") for k, t in rows], "doc_id long, text string, part string")
    got = substring.remove_repeats(docs, window=window).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=repr)


def test_against_brute_force(llm, texts, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)  # repeats within chunks and across them
    pick = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = list(texts)
    for i in range(60):
        words = [f"w{pick.randrange(400)}" for _ in range(pick.randrange(0, 120))]
        if i % 3 == 0:
            at, a = pick.randrange(len(words) + 1), pick.randrange(0, 20)
            words[at:at] = passage[a:a + pick.choice([34, 35, 40])]
        rows.append((100 + i, pick.choice([" ", "\n", "  "]).join(words)))
    rows.append((900, " ".join(["same"] * 36)))  # overlaps itself
    rows.append((901, " ".join(["once"] * 35)))
    assert run(llm, rows, 35) == brute(rows, 35)
    assert run(llm, rows, 3) == brute(rows, 3)


def test_empty_table(llm):
    assert run(llm, [], 35) == []
    assert run(llm, [(1, None), (2, "")], 35) == [(1, 0, 0, ""), (2, 0, 0, "")]
