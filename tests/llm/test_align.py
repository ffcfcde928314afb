"""The alignment against plain loops over both libraries' tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from netpen.llm import align, bpe, queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabularies():
    return align.read_vocabularies(A_PATH, B_PATH)


def tokens(text, tokenizer, pieces, names):
    """Both sides' (id, first byte, end) lists, or none where the bytes do not come out."""
    if not text:
        return [], []
    a = [(i, names[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pieces.encode(text):
        piece = pieces.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("\u2581", " ").encode()))
    out = []
    for side in (a, b):
        if b"".join(p for _, p in side) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, p in side:
            spans.append((i, at, at + len(p)))
            at += len(p)
        out.append(spans)
    return out


def brute(texts):
    tokenizer = Tokenizer.from_file(A_PATH)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    names = bpe.piece_bytes(bpe.read_vocabulary(A_PATH))
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(text, tokenizer, pieces, names)
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            at = first
            while at < len(b) and b[at][1] < e:
                links.append((i, b[at][0]))
                at += 1
        counts.update(links)
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, left, right = [], 0, 0
        for end in shared:
            ids = [[], []]
            while left < len(a) and a[left][2] <= end:
                ids[0].append(str(a[left][0]))
                left += 1
            while right < len(b) and b[right][2] <= end:
                ids[1].append(str(b[right][0]))
                right += 1
            groups.append(",".join(ids[0]) + "|" + ",".join(ids[1]))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        found.append((len(a), len(b), len(shared), links, digest))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), d)
            for n_a, n_b, n_g, links, d in found]


def corpus(texts):
    pick = random.Random(3)
    pools = [range(0x20, 0x7F), [0x20, 9, 10, 13, 0xA0, 0x2003, 0x2581, 0], range(0xA0, 0x3000), range(0x3000, 0xD800),
             range(0xE000, 0x110000), [ord(c) for c in "'strevmld "]]
    odd = ["".join(chr(pick.choice(pick.choice(some))) for _ in range(pick.randrange(50)))
           for some in (pick.sample(pools, pick.randrange(1, 4)) for _ in range(300))]
    return [t for _, t in texts] + odd + [
        "<s> a </s> <unk> <0x41> <|endoftext|>", " leading", "trailing ", "  ", " ", "\n", "x" * 5000, "\ufeffa", "a\u2581b"]


@pytest.mark.parametrize("links", [500, 2_000_000])
def test_equals_loops(llm, texts, vocabularies, monkeypatch, links):
    monkeypatch.setattr(align, "CHUNK_LINKS", links)
    monkeypatch.setattr(align, "BATCH_BYTES", 3000 if links == 500 else align.BATCH_BYTES)
    given = corpus(texts)
    docs = llm.createDataFrame([(i, t, "k", i) for i, t in enumerate(given)],
                               "doc_id long, text string, row string, chunk long")
    got = sorted(tuple(r) for r in align.align(docs, vocabularies).collect())
    assert got == [(i, "k", i, *want) for i, want in enumerate(brute(given))]


def test_query(llm, texts, tmp_path):
    llm.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_a int").write.parquet(
        str(tmp_path / "documents.parquet"))
    frame = queries.op12_align(llm, str(tmp_path))
    assert frame.columns == ["doc_id", *align.COUNTS, "groups_sha256"]
    want = [(i, *w) for (i, _), w in zip(texts, brute([t for _, t in texts]))]
    assert sorted([tuple(r) for r in frame.collect()], key=repr) == sorted(want, key=repr)


def test_empty_tables_and_clashing_names(llm, vocabularies):
    empty = llm.createDataFrame([], "doc_id long, text string")
    assert align.align(empty, vocabularies).count() == 0
    nothing = llm.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align.align(nothing, vocabularies).collect()) == [
        (1, *[0] * 6, ""), (2, *[0] * 6, "")]
    with pytest.raises(ValueError):
        align.align(llm.createDataFrame([], "n_best long, text string"), vocabularies)
