"""Byte-level BPE by ranks, in two tiers, and decoding back to bytes.

A text is split by the vocabulary's pattern. The first tier is a minimal perfect hash over the
vocabulary: as many slots as tokens, and one displacement per bucket of about three tokens that sends
each of them to a slot of its own. A pre-token's slot holds the one token it could be; if the bytes are
the same, its id is the answer. The second tier takes the misses: the bytes as a linked list, the
neighbours' ranks in a heap, the lowest rank (leftmost first) merged until none is left.

Each task works on its own rows, block by block of ``BLOCK_WORDS`` pre-tokens, and looks each distinct
pre-token of a block up once; nothing is shuffled or collected, and no key can be hot. What every task
receives is bounded by the vocabulary. A lost task is repeated from its own input alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netpen.llm.common import nullable

BLOCK_WORDS = 400_000
MEMO_WORDS = 500_000   # misses a task remembers (about 100 MB); forgetting them costs time only
MEMO_BYTES = 64        # longer misses are rare and not remembered
BUCKET = 3             # tokens per bucket of the perfect hash, on average

BLANK = r"\s"
CLASSES = (r"\p{L}", r"\p{N}", BLANK)   # what a pattern may name

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        lines = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in lines}


class PerfectHash(NamedTuple):
    """``displace`` per bucket (negative: the slot itself, -1 - slot), ``tokens`` and ``ids`` per slot."""

    seed: int
    displace: np.ndarray
    tokens: list[bytes]
    ids: np.ndarray


def _hashes(words: Iterable[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, seed) for w in words], np.uint64)


def _slots(hashes: np.ndarray, displace: np.ndarray, size: int) -> np.ndarray:
    """Where a displacement sends a hash: a 64-bit mix of both, modulo the number of slots."""
    with np.errstate(over="ignore"):
        x = hashes + displace.astype(np.uint64) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def perfect_hash(ranks: dict[bytes, int]) -> PerfectHash:
    """Buckets are placed from the fullest to the emptiest, each by the first displacement whose slots are free."""
    tokens = list(ranks)
    size, seed = len(tokens), 0
    while True:
        hashes = _hashes(tokens, seed)
        if len(np.unique(hashes)) == size:
            break
        seed += 1
    n_buckets = max(1, size // BUCKET)
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    free = np.ones(size, bool)
    displace, at = np.zeros(n_buckets, np.int64), np.zeros(size, np.int64)
    fill = np.diff(starts)
    for b in np.argsort(-fill, kind="stable"):
        members = order[starts[b]:starts[b + 1]]
        if len(members) < 2:
            break
        first, step = 0, 16
        while True:
            tried = np.arange(first, first + step)
            slots = _slots(hashes[members][None, :], tried[:, None], size)
            fits = free[slots].all(axis=1)
            ordered = np.sort(slots, axis=1)
            fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                best = int(np.argmax(fits))
                displace[b], at[members] = tried[best], slots[best]
                free[slots[best]] = False
                break
            first, step = first + step, min(step * 4, 1 << 14)
    left = np.flatnonzero(free)
    alone = np.flatnonzero(fill == 1)
    members = order[starts[alone]]
    displace[alone], at[members] = -1 - left, left
    by_slot = np.argsort(at)
    return PerfectHash(seed, displace, [tokens[i] for i in by_slot],
                       np.array([ranks[tokens[i]] for i in by_slot], np.int64))


def look_up(table: PerfectHash, words: list[bytes]) -> np.ndarray:
    """The id of each word that is a token, else -1."""
    size = len(table.tokens)
    if not size or not words:
        return np.full(len(words), -1, np.int64)
    hashes = _hashes(words, table.seed)
    displace = table.displace[(hashes % np.uint64(len(table.displace))).astype(np.int64)]
    slots = np.where(displace < 0, -1 - displace, _slots(hashes, np.maximum(displace, 0), size))
    same = np.fromiter((table.tokens[s] == w for s, w in zip(slots.tolist(), words)), bool, len(words))
    return np.where(same, table.ids[slots], -1)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by merges: the pair of lowest rank first, of equal ones the leftmost.

    The heap holds rank and first byte of each pair as one number. ``pair`` has the rank of the pair
    that begins at a byte now, so that entries from before a merge are told by their rank.
    """
    n, get, none = len(word), ranks.get, 1 << 32
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(word[i:i + 2], none) for i in range(n - 1)]
    pair.append(none)
    heap = [rank << 32 | i for i, rank in enumerate(pair) if rank != none]
    heapify(heap)
    while heap:
        lowest = heappop(heap)
        i = lowest & 0xFFFFFFFF
        if pair[i] != lowest >> 32:
            continue
        gone = after[i]
        stop = after[i] = after[gone]
        pair[i] = pair[gone] = none
        if stop < n:
            before[stop] = i
            rank = pair[i] = get(word[i:after[stop]], none)
            if rank != none:
                heappush(heap, rank << 32 | i)
        first = before[i]
        if first >= 0:
            rank = pair[first] = get(word[first:stop], none)
            if rank != none:
                heappush(heap, rank << 32 | first)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:after[i]]])
        i = after[i]
    return out


class Splitter:
    """Splits texts by a pattern whose character classes are those of the tiktoken library.

    The regex module may know another Unicode version. The characters it classes differently are
    found once, on the driver (``differences``); only texts that hold one are split by spelled-out classes.
    """

    def __init__(self, pattern: str, spelled: dict[str, str], odd: str, lowest: int):
        import regex

        self.plain = regex.compile(pattern)
        self.odd = regex.compile(f"[{odd}]") if odd else None
        if odd:
            self.lowest = lowest
            for name, ranges in spelled.items():
                pattern = pattern.replace(name, f"[{ranges}]")
            # Version 1 allows a class within a class. \S is the complement of \s.
            self.exact = regex.compile(pattern.replace(r"\S", f"[^{spelled[BLANK]}]"), regex.V1)

    def _pattern(self, text: str):
        if self.odd is None or text.isascii():
            return self.plain
        # Most texts are told by their highest character alone, which is quicker than a search.
        highest = np.frombuffer(text.encode("utf-32-le"), "<u4").max()
        return self.exact if highest >= self.lowest and self.odd.search(text) else self.plain

    def words(self, text: str) -> Iterator[str]:
        return (m[0] for m in self._pattern(text).finditer(text))

    def list(self, text: str) -> list[str]:
        return self._pattern(text).findall(text)


def differences() -> tuple[dict[str, str], str, int]:
    """The library's classes as ranges, the characters that the regex module classes differently, and the lowest
    of those."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    spelled, odd = {}, set()
    for name in CLASSES:
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(library.encode_ordinary(every)).decode())
        spelled[name] = _ranges(theirs)
        odd |= theirs ^ set(regex.findall(name, every))
    return spelled, _ranges(odd), min(map(ord, odd), default=0)


def _ranges(characters: set[str]) -> str:
    points = np.array(sorted(map(ord, characters)), np.int64)
    if not len(points):
        return ""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(firsts, lasts))


class Encoder:
    """One task's encoder: the ids of blocks of pre-tokens, each distinct one looked up once."""

    def __init__(self, table: PerfectHash, ranks: dict[bytes, int], splitter: Splitter):
        self.table, self.ranks, self.splitter = table, ranks, splitter
        self.memo: dict[bytes, list[int]] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        block, cuts = [], []   # pre-tokens not yet encoded, and where in them texts end
        begun = b""            # ids of the text that an earlier block holds the beginning of
        for text in texts:
            if len(text) <= BLOCK_WORDS:
                block += self.splitter.list(text)
            else:
                for word in self.splitter.words(text):
                    block.append(word)
                    if len(block) >= BLOCK_WORDS:
                        *done, rest = self._block(block, cuts)
                        for ids in done:
                            yield begun + ids
                            begun = b""
                        begun += rest
                        block, cuts = [], []
            cuts.append(len(block))
            if len(block) >= BLOCK_WORDS:
                *done, _ = self._block(block, cuts)
                for ids in done:
                    yield begun + ids
                    begun = b""
                block, cuts = [], []
        *done, _ = self._block(block, cuts)
        for ids in done:
            yield begun + ids
            begun = b""

    def _block(self, words: list[str], cuts: list[int]) -> list[bytes]:
        """The ids of each text that ends in the block, and those of what comes after the last."""
        if not words:
            return [b""] * (len(cuts) + 1)
        coded = pa.array(words, pa.string()).dictionary_encode()
        index = coded.indices.to_numpy()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = look_up(self.table, distinct)
        sizes = np.ones(len(distinct), np.int64)
        missed = np.flatnonzero(ids < 0)
        merged = [self._miss(distinct[i]) for i in missed]
        sizes[missed] = [len(m) for m in merged]
        flat = np.repeat(ids, sizes)
        if merged:
            flat[np.repeat(ids < 0, sizes)] = np.fromiter(chain.from_iterable(merged), np.int64)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        out = flat[np.arange(ends[-1]) + np.repeat(starts[index] - (ends - lengths), lengths)].astype("<u4").tobytes()
        places = [0, *(4 * np.r_[0, ends][np.array(cuts, np.int64)]).tolist(), len(out)]
        return [out[a:b] for a, b in zip(places, places[1:])]

    def _miss(self, word: bytes) -> list[int]:
        found = self.memo.get(word)
        if found is None:
            found = merge(word, self.ranks)
            if len(word) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = found
        return found


def _held(keep: list[str]) -> Column:
    """One struct of the kept columns, so that their names clash with nothing else."""
    held = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int"))
    return held.alias("row")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the ``keep`` columns (all but the text) and ``ids``, little-endian unsigned 32-bit
    integers, equal to the tiktoken library's ``encode_ordinary`` of the whole text.

    Null and empty texts give no ids. Repeated rows stay repeated. Texts of any length are taken in
    blocks. An empty table gives an empty one. Every single byte must have a rank. Columns of any
    name may be kept, save that ``ids`` would be ambiguous and raises.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if "ids" in keep:
        raise ValueError("a kept column is named ids")
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("a byte has no rank")
    rows = docs.select(_held(keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # Bounded by the vocabulary and by Unicode's classes.
    shared = docs.sparkSession.sparkContext.broadcast(
        {"table": perfect_hash(ranks), "ranks": ranks, "pattern": pattern, "classes": differences()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        if "encoder" not in given:  # kept for the worker's later tasks
            given["encoder"] = Encoder(given["table"], given["ranks"], Splitter(given["pattern"], *given["classes"]))
        encoder = given["encoder"]
        for batch in batches:
            ids = list(encoder.encode(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["row", "ids"])

    schema = T.StructType([T.StructField("row", nullable(rows.schema["row"].dataType)),
                           T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], "ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace ``ids`` by the bytes ``out``. Ids without a token add nothing; null ids give empty bytes."""
    keep = [c for c in encoded.columns if c != ids]
    if out in keep:
        raise ValueError(f"a column is already named {out}")
    pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    rows = encoded.select(_held(keep), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([T.StructField("row", nullable(rows.schema["row"].dataType)),
                           T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([*shared.value, b""], dtype=object)[:-1]
        for batch in batches:
            found = []
            for one in batch.column(1):
                numbers = np.frombuffer(one.as_py() or b"", "<u4")
                found.append(b"".join(table[numbers[numbers < len(table)]].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["row", "bytes"])

    return rows.mapInArrow(run, schema).select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("bytes").alias(out))
