import random

import numpy as np
from xxhash import xxh64_intdigest

from netpen.llm import simhash
from netpen.llm.components import components


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def signed(x):
    return int(np.uint64(x).astype(np.int64))


def test_fingerprints_and_components(llm, texts):
    docs = llm.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, root int")
    got = simhash.near_duplicates(docs).collect()
    prints = {plain(t) for _, t in texts}
    root = groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, t in texts:
        if i is not None:
            least[root[plain(t)]] = min(i, least.get(root[plain(t)], i))
    want = [(i, signed(plain(t)), least.get(root[plain(t)])) for i, t in texts]
    assert sorted([(r.doc_id, r.simhash, r.component_id) for r in got], key=repr) == sorted(want, key=repr)


def test_links_in_large_cells_and_chains(llm):
    pick = random.Random(5)
    prints = set()
    for _ in range(40):  # clusters of chained fingerprints, and lone ones
        x = pick.getrandbits(64)
        for _ in range(pick.choice([1, 2, 30])):
            prints.add(x)
            for _ in range(pick.randint(1, 6)):
                x ^= 1 << pick.randrange(64)
    table = llm.createDataFrame([(signed(p),) for p in prints] + [(None,)], "simhash long")
    root = groups(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    members = {}
    for p, r in root.items():
        members.setdefault(r, []).append(signed(p))
    want = {(m, min(g)) for g in members.values() for m in g if m != min(g)}
    for block in (2048, 4):  # the second deals nearly every cell into blocks
        got = {(r.node, r.root) for r in simhash.link_groups(table, block=block).collect()}
        assert got == want


def test_one_per_group(llm, texts):
    docs = llm.createDataFrame(texts, "doc_id long, text string")
    kept = sorted([(r.doc_id, r.text) for r in simhash.one_per_group(docs).collect()], key=repr)
    classes = {}
    root = groups({plain(t) for _, t in texts}, lambda a, b: bin(a ^ b).count("1") <= 4)
    for i, t in texts:
        c = root[plain(t)]
        classes[c] = min(classes.get(c, (True, 0)), (i is None, i or 0))
    assert sorted([(i is None, i or 0) for i, _ in kept]) == sorted(classes.values())
    assert simhash.one_per_group(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_links(llm):
    links = llm.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (None, 4), (20, 30), (30, 40), (40, 50), (50, 60)],
                                "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {2: 1, 3: 1, 9: 8, 30: 20, 40: 20, 50: 20, 60: 20}
    assert components(links.limit(0)).count() == 0
