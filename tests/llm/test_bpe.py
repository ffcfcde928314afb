import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netpen.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def library(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def key(row):
    return repr(row)


def test_equals_the_library(llm, texts, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 5000)  # several chunks
    extra = texts + [(20, "<|endoftext|><|endoftext|>"), (21, "a  <|endoftext|>  b!!<|endoftext|>"),
                     (22, "it's we'LL  \n\n x\t\ty 123abc !?"), (23, "x" * 3000)]
    docs = llm.createDataFrame([(i, t, "k", 1) for i, t in extra], "doc_id long, text string, chunk string, shard int")
    got = bpe.decode(bpe.encode(docs, vocabulary).withColumnRenamed("ids", "i"), vocabulary, "i").collect()
    ids = bpe.encode(docs, vocabulary).collect()
    assert sorted([(r.doc_id, r.chunk, r.shard, np.frombuffer(r.ids, "<u4").tolist()) for r in ids], key=key) == sorted(
        [(i, "k", 1, library(t)[0]) for i, t in extra], key=key)
    assert sorted([(r.doc_id, r.decoded) for r in got], key=key) == sorted(
        [(i, library(t)[1]) for i, t in extra], key=key)


def test_empty_table_and_clashing_names(llm, vocabulary):
    empty = llm.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, vocabulary), vocabulary).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(llm.createDataFrame([], "ids long, text string"), vocabulary)


def test_columns_that_are_never_null(llm, vocabulary):
    rows = llm.range(5).selectExpr("id", "struct(id as a, 'x' as b) as s", "array(id) as v", "'some text' as text")
    got = bpe.encode(rows, vocabulary).collect()
    assert sorted(r.id for r in got) == list(range(5)) and all(r.s.b == "x" and r.v == [r.id] for r in got)


def test_a_second_reading_in_another_order_is_told(llm, vocabulary):
    rows = llm.range(2000).selectExpr("reflect('java.util.UUID', 'randomUUID') as text", "id")
    with pytest.raises(Exception, match="second time"):
        bpe.encode(rows, vocabulary).collect()


def test_decode_passes_over_unknown_ids(llm, vocabulary):
    rows = llm.createDataFrame([(1, bytearray(np.array([15496, 4_000_000_000], "<u4").tobytes())), (2, None)],
                               "k int, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(rows, vocabulary).collect()} == {1: "Hello", 2: ""}
