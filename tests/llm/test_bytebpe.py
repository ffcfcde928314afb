import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from netpen.llm import bytebpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(ranks):
    return bytebpe.Encoder(bytebpe.perfect_hash(ranks), ranks,
                           bytebpe.Splitter(public_tokenizers.PATTERN, *bytebpe.differences()))


def test_the_perfect_hash_is_minimal_and_finds_tokens_only(ranks):
    table = bytebpe.perfect_hash(ranks)
    assert len(table.tokens) == len(ranks) and set(table.tokens) == set(ranks)
    words = list(ranks)
    assert bytebpe.look_up(table, words).tolist() == list(ranks.values())
    others = [w for i in range(20000) if (w := f"no{i}token".encode()) not in ranks]
    assert (bytebpe.look_up(table, others) == -1).all()
    small = bytebpe.perfect_hash({b"a": 3})
    assert bytebpe.look_up(small, [b"a", b"b", b""]).tolist() == [3, -1, -1]
    assert bytebpe.look_up(bytebpe.perfect_hash({}), [b"a"]).tolist() == [-1]


@pytest.mark.parametrize("block", [7, 400_000])
def test_random_texts_of_all_scripts_equal_the_library(ranks, library, monkeypatch, block):
    monkeypatch.setattr(bytebpe, "BLOCK_WORDS", block)
    monkeypatch.setattr(bytebpe, "MEMO_WORDS", 50)
    pick = random.Random(5)
    pools = [range(0x20, 0x7F), [0x20, 9, 10, 13, 0xA0, 0x2003, 0x85, 0x1C], range(0xA0, 0x3000),
             range(0x3000, 0xD800), range(0xE000, 0x110000), [ord(c) for c in "'strevmld "],
             range(0x323B0, 0x33500), [0x558, 0x58B, 0x88F, 0xC5C]]
    texts = ["".join(chr(pick.choice(pick.choice(some))) for _ in range(pick.randrange(60)))
             for some in (pick.sample(pools, pick.randrange(1, 5)) for _ in range(1500))]
    texts += ["", "x" * 20000, "ab " * 20000, " " * 5000 + "end", "", "<|endoftext|> it's we'LL \n\n x"]
    got = list(encoder(ranks).encode(texts))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_every_character_is_split_as_the_library_does(ranks, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pick = random.Random(9)
    pick.shuffle(every)
    texts = ["".join(every[i:i + 500]) for i in range(0, len(every), 500)]
    for text, ids in zip(texts, encoder(ranks).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_tables(llm, texts, ranks, library, tmp_path):
    docs = llm.createDataFrame([(i, t, "k", i) for i, t in texts], "doc_id long, text string, row string, _ long")
    ids = bytebpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = bytebpe.decode(ids.withColumn("copy", ids["ids"]), ranks).collect()
    want = [(i, "k", i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts]
    assert sorted([(r.doc_id, r.row, r._, np.frombuffer(r.copy, "<u4").tolist(), bytes(r.decoded)) for r in got],
                  key=repr) == sorted(want, key=repr)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_bytebpe(llm, str(tmp_path)).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted([tuple(r) for r in rows], key=repr) == sorted(
        [(i, len(n), digest(np.array(n, "<u4").tobytes()), digest(b)) for i, _, _, n, b in want], key=repr)


def test_empty_tables_clashing_names_and_unknown_ids(llm, ranks):
    empty = llm.createDataFrame([], "doc_id long, text string")
    assert bytebpe.decode(bytebpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    with pytest.raises(ValueError):
        bytebpe.encode(llm.createDataFrame([], "ids long, text string"), ranks, public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        bytebpe.encode(empty, {b"a": 0}, public_tokenizers.PATTERN)
    rows = llm.createDataFrame([(1, bytearray(np.array([ranks[b"a"], 4_000_000_000], "<u4").tobytes())), (2, None)],
                               "k int, ids binary")
    assert {r.k: bytes(r.decoded) for r in bytebpe.decode(rows, ranks).collect()} == {1: b"a", 2: b""}
