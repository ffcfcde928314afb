"""Cross-tokenizer alignment: which tokens of two vocabularies overlap, and how often corpus-wide.

Each batch of texts is encoded by both tokenizers. Byte offsets count on through a batch, so that each
side's token starts are sorted; ``pandas.merge_asof``, keyed by document, finds for each token start the
other side's token that covers it. The union of both directions is all overlapping pairs: of two
overlapping tokens one starts within the other. Offsets where both sides end cut a text into groups.

Pairs of ids are counted over the corpus. A chunk of texts (``CHUNK_LINKS`` links, or one text) has one
dictionary of its distinct id pairs and how often each occurs; texts keep codes into it. The
dictionaries' rows meet by pair, where partial sums come before the shuffle, and return to their chunks
with the corpus-wide counts; each chunk then sums up its texts. So a frequent pair is one row a chunk,
no row per link is ever shuffled, and the texts are encoded once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from netpen.llm.bpe import _pack, _unpack, piece_bytes, read_vocabulary
from netpen.llm.common import nullable
from netpen.session import stage

CHUNK_LINKS = 2_000_000
BATCH_BYTES = 2_000_000  # text that is aligned at once; a longer text is a batch of its own

# The split pattern of the vocabulary's byte-level pre-tokenizer, and the mark of a space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_MARK = "▁"

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabularies(NamedTuple):
    """What the tasks load the two tokenizers from."""

    ranks: dict[bytes, int]   # byte-level BPE: token bytes and ids
    model: bytes              # the piece model


def read_vocabularies(byte_level: str, pieces: str) -> Vocabularies:
    """Vocabulary files of both sides: a byte-level BPE (JSON) whose ids follow its merges, and a piece model."""
    text = read_vocabulary(byte_level)
    kind = json.loads(text)["model"]
    ids = kind["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in kind["merges"]]
    if [ids[m] for m in merged] != list(range(256, 256 + len(merged))) or any(
            kind.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("ids do not follow the merges")
    named = piece_bytes(text)
    with open(pieces, "rb") as file:
        return Vocabularies({named[i]: i for i in range(256 + len(merged))}, file.read())


class Tokens(NamedTuple):
    """The tokens of a batch, one after the other: ids, start offsets in the batch, texts they belong to."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


class Aligner:
    """Both tokenizers, built once per Python worker."""

    def __init__(self, given: Vocabularies):
        import sentencepiece
        import tiktoken

        # Equal to the tokenizers library with special tokens as plain text, and several times as quick.
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=given.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=given.model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.piece_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_b = np.array([len(p) for p in self.piece_b], np.int64)
        self.piece_b = np.array([*self.piece_b, b""], dtype=object)[:-1]
        self.size_a = np.zeros(max(given.ranks.values()) + 1, np.int64)
        self.size_a[list(given.ranks.values())] = [len(t) for t in given.ranks]
        # Each id as text with what follows it: within and at the end of a group's first and second part.
        names = [*range(max(len(self.size_a), len(self.size_b)))]
        self.text = [np.array([f"{i}{mark}" for i in names], dtype=object) for mark in ",|,;"]

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Counts per text, digests of the groups, and all links: text and id pair (a << 32 | b)."""
        given = [" " + t for t in texts]
        ids_a = [self.a.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for t in given]
        ids_b = [np.array(i, np.int64) for i in self.b.encode(texts, num_threads=1)] if texts else []
        for n, text in enumerate(given):
            # Byte-level tokens give back any text; pieces may stand for a changed one.
            if len(text) == 1 or b"".join(self.piece_b[ids_b[n]].tolist()) != text.encode():
                ids_a[n] = ids_b[n] = np.zeros(0, np.int64)
        a, b = _tokens(ids_a, self.size_a), _tokens(ids_b, self.size_b)
        at_a, at_b = overlaps(a, b)
        shared = np.intersect1d(a.end, b.end, assume_unique=True)
        size = len(texts)
        counts = {"n_a": np.bincount(a.doc, minlength=size), "n_b": np.bincount(b.doc, minlength=size),
                  "n_groups": np.bincount(a.doc[np.searchsorted(a.end, shared)], minlength=size),
                  "n_links": np.bincount(a.doc[at_a], minlength=size)}
        return (counts, self._digests(a, b, shared, counts["n_a"] + counts["n_b"]),
                a.doc[at_a], a.ids[at_a] << 32 | b.ids[at_b])

    def _digests(self, a: Tokens, b: Tokens, shared: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Per text the digest of its groups in order, each ``a1,a2|b1``, joined by semicolons."""
        last_a, last_b = np.isin(a.end, shared), np.isin(b.end, shared)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        parts = np.empty(len(a.ids) + len(b.ids), dtype=object)
        # In order: a token of the first side comes after the second side's tokens of earlier groups.
        place_a = np.arange(len(a.ids)) + np.searchsorted(group_b, group_a, side="left")
        place_b = np.arange(len(b.ids)) + np.searchsorted(group_a, group_b, side="right")
        for place, ids, last, (within, at_end) in ((place_a, a.ids, last_a, self.text[:2]),
                                                   (place_b, b.ids, last_b, self.text[2:])):
            parts[place] = np.where(last, at_end[ids], within[ids])
        ends = np.cumsum(lengths).tolist()
        return [hashlib.sha256("".join(parts[i:j].tolist())[:-1].encode()).hexdigest() if j > i else ""
                for i, j in zip([0, *ends[:-1]], ends)]


def _tokens(ids: list[np.ndarray], sizes: np.ndarray) -> Tokens:
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    ends = np.cumsum(sizes[flat])
    return Tokens(flat, ends - sizes[flat], ends, np.repeat(np.arange(len(ids)), [len(i) for i in ids]))


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all pairs of tokens of one text whose bytes overlap, each pair once."""
    import pandas as pd

    left = pd.DataFrame({"at": a.start, "doc": a.doc, "start_a": a.start, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "doc": b.doc, "b": np.arange(len(b.ids))})
    # The token of the other side that covers a start is the last that begins no later.
    covering_b = pd.merge_asof(left[["at", "doc", "a"]], right, on="at", by="doc")
    covering_a = pd.merge_asof(right, left, on="at", by="doc")
    # Pairs that begin at the same byte are in both.
    covering_a = covering_a[covering_a["start_a"] != covering_a["at"]]
    return (np.concatenate([covering_b["a"].to_numpy(np.int64), covering_a["a"].to_numpy(np.int64)]),
            np.concatenate([covering_b["b"].to_numpy(np.int64), covering_a["b"].to_numpy(np.int64)]))


def align(docs: DataFrame, vocabularies: Vocabularies, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the ``keep`` columns (all but the text), ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum`` (long) and ``groups_sha256``.

    Side A encodes a space and the text, special tokens as plain text; side B the text, to which it adds the
    space. ``n_best`` counts links whose id pair occurs corpus-wide as often as any pair of its B id;
    ``count_sum`` sums the corpus-wide counts of the links' pairs. Null and empty texts, and texts that
    B's normalising changes, have no tokens: zeros and an empty digest. Repeated rows each count. An
    empty table gives an empty one. Kept columns may have any name but those of the result, which raise.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if clash := {*COUNTS, "groups_sha256"} & {*keep}:
        raise ValueError(f"kept columns are named {sorted(clash)}")
    # One struct holds the kept columns, so their names clash with nothing below.
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int"))
    rows = docs.select(kept.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    row_type = nullable(rows.schema["row"].dataType)
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    # Rows of texts and, one a chunk, dictionaries: the arrays of id pairs and their numbers.
    whole = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("row", row_type), *counts[:4],
        T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.BinaryType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pair", "n")]])
    found = stage(rows.mapInArrow(_chunks(rows, vocabularies), whole), "aligned")
    pairs = found.where(F.col("pair").isNotNull()).select(
        "chunk", F.posexplode(F.arrays_zip("pair", "n")).alias("code", "entry")).select(
        "chunk", "code", "entry.pair", "entry.n")
    totals = stage(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = totals.groupBy(second.alias("b")).agg(F.max("count").alias("most"))
    # One row per id of the second vocabulary, whatever the corpus.
    judged = totals.join(F.broadcast(most), second == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    scored = pairs.join(judged, "pair").select(F.col("chunk").alias("of_chunk"), "code", "count", "best")
    texts = found.where(F.col("row").isNotNull()).drop("pair", "n")
    out = T.StructType([T.StructField("row", row_type), *counts, T.StructField("groups_sha256", T.StringType())])
    summed = texts.groupBy("chunk").cogroup(scored.groupBy("of_chunk")).applyInArrow(_sum_up, out)
    return summed.select(*[F.col("row")[c].alias(c) for c in keep], *COUNTS, "groups_sha256")


def _chunks(rows: DataFrame, vocabularies: Vocabularies):
    source = rows.sparkSession.sparkContext.broadcast({"files": vocabularies})  # two fixed files, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = source.value
        if "aligner" not in shared:
            shared["aligner"] = Aligner(shared["files"])
        number = TaskContext.get().partitionId() << 32
        held, links = [], 0
        for part, texts in _batches(batches):
            held.append((part, *shared["aligner"].align(texts)))
            links += len(held[-1][-1])
            if links >= CHUNK_LINKS:
                yield from _chunk(number, held)
                number, held, links = number + 1, [], 0
        if held:
            yield from _chunk(number, held)

    return run


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows and texts of about ``BATCH_BYTES``, or one text."""
    for batch in batches:
        row, text = batch.column(0), batch.column(1)
        ends = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
        first = 0
        while first < len(row):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield row.slice(first, last - first), text.slice(first, last - first).to_pylist()
            first = last


def _chunk(number: int, held: list) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk's texts with codes into its dictionary, and the dictionary."""
    row = pa.concat_arrays([h[0] for h in held])
    counts = {c: np.concatenate([h[1][c] for h in held]) for c in COUNTS[:4]}
    offsets = np.cumsum([0, *[len(h[0]) for h in held]])
    doc = np.concatenate([h[3] + o for h, o in zip(held, offsets)])
    pair, code, n = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True, return_counts=True)
    # Frequent pairs get small codes, which compress well.
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    both, times = np.unique(doc << 32 | rank[code], return_counts=True)
    ends = np.searchsorted(both, np.arange(1, len(row) + 1) << 32)
    code = (both & 0xFFFFFFFF).astype(np.uint32)
    codes = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        # Sorted codes as their differences.
        codes.append(_pack(np.concatenate([np.diff(code[a:b], prepend=np.uint32(0)), times[a:b].astype(np.uint32)]))
                     if b > a else b"")
    size = len(row)
    columns = {"chunk": pa.array(np.full(size, number)), "row": row, **{c: pa.array(v) for c, v in counts.items()},
               "groups_sha256": pa.array([d for h in held for d in h[2]], pa.string()),
               "codes": pa.array(codes, pa.binary())}
    lists = pa.list_(pa.int64())
    yield pa.RecordBatch.from_pydict(columns | {c: pa.nulls(size, lists) for c in ("pair", "n")})
    if len(pair):
        yield pa.RecordBatch.from_pydict(
            {c: pa.nulls(1, v.type) for c, v in columns.items()} | {"chunk": pa.array([number])}
            | {"pair": pa.array([pair[order]], lists), "n": pa.array([n[order]], lists)})


def _sum_up(texts: pa.Table, scored: pa.Table) -> pa.Table:
    """The texts of a chunk with their links' counts summed up."""
    code = scored.column("code").to_numpy()
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    count[code] = scored.column("count").to_numpy()
    best[code] = scored.column("best").to_numpy()
    n_best, count_sum = [], []
    for packed in texts.column("codes"):
        data = packed.as_py()
        if not data:
            n_best.append(0)
            count_sum.append(0)
            continue
        numbers = _unpack(data)[0]
        at = np.cumsum(numbers[:len(numbers) // 2], dtype=np.int64)
        times = numbers[len(numbers) // 2:].astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    out = {c: texts.column(c) for c in ("row", *COUNTS[:4])}
    return pa.table(out | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                           "groups_sha256": texts.column("groups_sha256")})
