import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from netpen.llm import quality


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dups, len(covered))


def sample():
    pick = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "ka", "mir", "te") for b in ("n", "sta", "rel", "o", "vi")]
    rows = []
    for i in range(400):
        text = " ".join(pick.choice(words) for _ in range(pick.randrange(15, 300)))
        if i % 40 == 0:
            text = " ".join(w + pick.choice(["###", "$$$", "&&"]) for w in text.split())
        if i % 50 == 1:
            text = "\n".join([text[:60]] * 4 + [text])
        rows.append((i, text, ["en", "de", None][i % 3], f"s{i % 7 % 4}" if i % 7 else None))
    return rows


def reference(rows):
    """The same estimate with plain numpy, group by group."""
    stats = [counts(t) for _, t, _, _ in rows]
    failed = [s[0] < 20 or 100 * s[4] > 30 * s[0] for s in stats]

    def vector(s):
        n = max(s[0], 1)
        raw = [math.log1p(s[0]), math.log1p(s[1] / n), math.sqrt(s[2] / n), math.sqrt(s[3] / n), math.sqrt(s[4] / n)]
        return [min(max(round(x * quality.GRID), -quality.LIMIT), quality.LIMIT) for x in raw]

    x = np.array([vector(s) for s in stats], float)
    size = Counter((r[2], r[3]) for r, f in zip(rows, failed) if not f)
    pooled = Counter()
    for (lang, _), n in size.items():
        pooled[lang] += n if n < quality.MIN_GROUP else 0
    rest = sum(n for n in pooled.values() if n < quality.MIN_GROUP)
    groups = {}
    for i, (r, f) in enumerate(zip(rows, failed)):
        if not f:
            key = ((r[2], r[3]) if size[r[2], r[3]] >= quality.MIN_GROUP else
                   (r[2],) if pooled[r[2]] >= quality.MIN_GROUP else () if rest >= quality.MIN_GROUP else None)
            if key is not None:
                groups.setdefault(key, []).append(i)
    floors = np.array(list(quality.FLOORS.values()))
    distance = [None] * len(rows)

    def quantile(values, share):
        return np.sort(values)[math.ceil(share * len(values)) - 1]

    def distances(z, mean, inverse):
        return np.einsum("ij,jk,ik->i", (z - mean) / quality.GRID, inverse, (z - mean) / quality.GRID)

    for members in groups.values():
        z = x[members]
        mean = np.array([quantile(c, 0.5) for c in z.T])
        spread = np.array([quantile(np.abs(c - m), 0.5) for c, m in zip(z.T, mean)])
        inverse = np.diag(1 / np.maximum(1.4826 * spread / quality.GRID, floors) ** 2)
        size, before = math.inf, None
        while before is None or size < before - quality.SETTLED:
            bins = np.floor(np.log1p(distances(z, mean, inverse)) * quality.BINS_PER_UNIT)
            near = z[bins <= quantile(bins, quality.SHARE)] / quality.GRID
            mean = near.mean(axis=0) * quality.GRID
            scatter = np.cov(near.T, bias=True) * quality.CONSISTENCY + np.diag(floors ** 2)
            inverse = np.linalg.inv(scatter)
            before, size = size, np.linalg.slogdet(scatter)[1]
        for i, value in zip(members, distances(z, mean, inverse)):
            distance[i] = value
    return stats, failed, distance


def test_counts(llm, texts):
    extra = texts + [(50, "a b c d e f g h a b c d e f g h"), (51, "x\nx\n x\nx\n\n\n"), (52, "a " * 30), (53, "#*$%&|<>\\")]
    docs = llm.createDataFrame([(i, t, 1) for i, t in extra], "doc_id long, text string, windows int")
    got = sorted([tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
                  for r in quality.statistics(docs).collect()], key=repr)
    assert got == sorted([(i, *counts(t)) for i, t in extra], key=repr)


@pytest.mark.parametrize("rows", [sample(), sample()[:70], sample()[:12], []], ids=["groups", "pool", "few", "none"])
def test_judgement(llm, rows):
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(quality.statistics(docs)).collect()}
    stats, failed, distance = reference(rows)
    assert len(got) == len(rows)
    for (i, *_), fail, d in zip(rows, failed, distance):
        assert got[i].base_failed == fail
        assert (got[i].distance is None) == (d is None)
        if d is not None:
            assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert got[i].kept == (not fail and (d is None or d <= quality.CUT))
    if len(rows) > 100:
        assert not all(got[i].kept for i in range(0, 400, 40)) and got[2].kept


def clean_texts(n):
    pick = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "ka", "mir", "te", "su") for b in ("n", "sta", "rel", "o", "vi", "me")]
    return [" ".join(pick.choice(words) for _ in range(pick.randrange(80, 300))) for _ in range(n)]


def kept_ids(llm, texts):
    docs = llm.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    return {r.doc_id for r in quality.judge(quality.statistics(docs)).where("kept").collect()}


def test_a_third_of_copies_of_junk_is_rejected(llm):
    junk = " ".join(f"w{i}$$" if i % 2 else f"v{i}#" for i in range(150))
    kept = kept_ids(llm, clean_texts(200) + [junk] * 100)
    assert not any(i >= 200 for i in kept) and len(kept) > 190


def test_each_axis_alone_rejects(llm):
    pick = random.Random(9)
    plain = clean_texts(1)[0].split()
    fresh = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    some = lambda n: [pick.choice(fresh) for _ in range(n)]

    def lines(width, n, distinct):
        menu = [" ".join(some(width)) for _ in range(distinct)]
        return "\n".join(pick.choice(menu) for _ in range(n))

    repeated = some(150)
    planted = [" ".join(some(60000)), " ".join(w * 12 for w in plain), " ".join(w + "$$" for w in plain),
               lines(2, 120, 24), lines(3, 120, 24), lines(5, 200, 40),
               " ".join(repeated + repeated[:20])]
    assert all(not (s[0] < 20 or 100 * s[4] > 30 * s[0]) for s in map(counts, planted))
    kept = kept_ids(llm, clean_texts(200) + planted)
    assert not any(i >= 200 for i in kept) and len(kept) > 190
