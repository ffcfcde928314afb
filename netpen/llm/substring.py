"""Removal of word sequences that occur more than once, with a count-min prefilter.

Texts are packed into chunks. A chunk numbers its distinct windows by their hash and

1. sketches them: ``DEPTH`` rows of counters, one per hash function, of which a chunk sends only the
   cells it touches. The sketches of all chunks are merged range by range of cells; each range tells
   each chunk which of its cells count two or more. There are ``CELLS`` cells per window of the corpus,
   so the sketch grows with the data and is nowhere held as a whole.
2. keeps the windows whose cells all count two or more. The sketch only overestimates, so no
   repeated window is lost; of the others some 5 % are kept in error.
3. sends these with longer hashes to exact groups, again by range, which answer what occurs twice.
4. removes the words covered by repeated windows.

Answers are one bit per window in the order of the question. A window is sent once per chunk, so a
passage in a third of all texts has one entry per chunk, not one per text. Windows are told apart by
96 bits of hash between chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from netpen.llm.common import width
from netpen.session import stage

WINDOW = 35
CHUNK_BYTES = 8_000_000
DEPTH = 2
CELLS = 4
RANGES_PER_PARTITION = 8

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW,
                   keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text) with n_words, n_removed (longs) and ``kept_text``.

    Every word covered by a window of ``window`` words that starts anywhere else too, in the same text
    or another, is removed; windows are judged on the input. The kept words are joined by one space.
    Null and empty texts have no words and an empty result; repeated rows repeat each other. An empty
    table gives an empty one.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if clash := {"n_words", "n_removed", "kept_text"} & set(keep):
        raise ValueError(f"columns already named {sorted(clash)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_")).alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    row_type = rows.schema["row"].dataType
    packed = stage(rows.mapInArrow(_chunks, T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.ArrayType(row_type)), T.StructField("texts", T.BinaryType())])), "text-chunks")
    row_type = packed.schema["rows"].dataType.elementType  # as read back: every field may be null
    # A word takes two bytes at least; most take about six.
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    range_bits = int(np.ceil(np.log2(RANGES_PER_PARTITION * width(docs))))
    cell_bits = max(range_bits + 4, int(np.ceil(np.log2(max(1, total / 6) * CELLS))))
    plan = (window, range_bits, cell_bits)

    asked = packed.select("chunk", "texts").mapInArrow(lambda b: _ask_sketch(b, *plan), PARTS)
    marked = asked.groupBy("part").applyInArrow(lambda t: _merge(t, cell_bits - range_bits), PARTS)
    texts = packed.select("chunk", "rows", "texts").repartition(width(docs), "chunk")
    kept = texts.groupBy("chunk").cogroup(_answers(marked)).applyInArrow(
        lambda a, b: _ask_exact(a, b, *plan), PARTS)
    repeated = kept.groupBy("part").applyInArrow(_group, PARTS)
    out = T.StructType([T.StructField("row", row_type), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = texts.groupBy("chunk").cogroup(_answers(repeated)).applyInArrow(
        lambda a, b: _remove(a, b, window, out), out)
    return done.select(*[F.col("row")[c].alias(c) for c in keep], "n_words", "n_removed", "kept_text")


# A question or an answer: of ``chunk``, to or from the range ``part``, ``n`` windows or cells.
PARTS = "chunk long, part long, n long, packed binary"


def _answers(parts: DataFrame):
    return parts.select(F.col("chunk").alias("to_chunk"), "part", "n", "packed").groupBy("to_chunk")


def _parts(rows: list[tuple[int, int, int, bytes]]) -> dict:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return {n: pa.array(c, k) for n, c, k in zip(["chunk", "part", "n", "packed"], columns, kinds)}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    number = TaskContext.get().partitionId() << 32
    pack = zstandard.ZstdCompressor(level=1)
    for row, text in _gather(batches):
        sizes = np.array([len(t.as_buffer()) for t in text], np.int64)
        first = 0
        while first < len(row):
            room = np.searchsorted(np.cumsum(sizes[first:]), CHUNK_BYTES, side="right")
            last = first + max(1, int(room))
            part = text.slice(first, last - first)
            # Their number, their lengths, then the texts without a gap.
            data = (np.array([len(part), *sizes[first:last]], "<i8").tobytes()
                    + b"".join(t.as_py() for t in part))
            rows = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), row.slice(first, last - first))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([int(sizes[first:last].sum())], pa.int64()), rows,
                 pa.array([pack.compress(data)], pa.binary())], ["chunk", "bytes", "rows", "texts"])
            number += 1
            first = last


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows and texts of batches put together until they have a chunk's bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.columns)
        size += batch.column(1).nbytes
        if size >= CHUNK_BYTES:
            yield tuple(pa.concat_arrays(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays(c) for c in zip(*held))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _rolling(words: np.ndarray, base: int, window: int) -> np.ndarray:
    """A hash of each run of ``window`` word hashes: a polynomial modulo 2**64."""
    n = len(words)
    powers = np.full(n, base, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * np.multiply.accumulate(powers), dtype=np.uint64)])
    return _mix((sums[window:] - sums[:-window]) * np.multiply.accumulate(inverse)[:n - window + 1])


class _Texts:
    """The words and windows of a chunk; the same each time it is opened."""

    def __init__(self, packed: bytes, window: int):
        import zstandard
        from xxhash import xxh64_intdigest

        raw = zstandard.ZstdDecompressor().decompress(packed)
        count = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", count, 8)
        ends = np.cumsum(sizes) + 8 * (count + 1)
        self.words: list[bytes] = []
        self.starts = [0]
        for end, size in zip(ends.tolist(), sizes.tolist()):
            self.words += raw[end - size:end].split()  # of bytes: ASCII white space
            self.starts.append(len(self.words))
        self.at = np.zeros(0, np.int64)      # where each window starts
        self.index = np.zeros(0, np.int64)   # its number among the distinct windows
        self.hashes = np.zeros(0, np.uint64)  # of the distinct windows, ascending
        self.twice = np.zeros(0, bool)       # more than once in this chunk
        self.first = np.zeros(0, np.int64)   # of the distinct windows: a place
        bounds = np.array(self.starts)
        room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(self.words)) >= window
        self.at = np.flatnonzero(room)
        self.word_hashes = np.zeros(0, np.uint64)
        if len(self.at):
            names = pa.array(self.words, pa.binary()).dictionary_encode()
            distinct = np.fromiter((xxh64_intdigest(w) for w in names.dictionary.to_pylist()),
                                   np.uint64, len(names.dictionary))
            self.word_hashes = distinct[names.indices.to_numpy()]
            own = _rolling(self.word_hashes, BASES[0], window)[self.at]
            self.hashes, self.first, self.index, counts = np.unique(
                own, return_index=True, return_inverse=True, return_counts=True)
            self.twice = counts > 1

    def longer(self, chosen: np.ndarray, window: int) -> np.ndarray:
        """32 more bits of hash for the chosen distinct windows."""
        more = _rolling(self.word_hashes, BASES[1], window)[self.at[self.first[chosen]]]
        return (more >> np.uint64(32)).astype(np.uint32)


def _cells(hashes: np.ndarray, depth: int, cell_bits: int) -> np.ndarray:
    return _mix(hashes + np.uint64(0x632BE59BD9B4E019 * (depth + 1) % (1 << 64))) >> np.uint64(64 - cell_bits)


def _by_range(values: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted values that share the bits above ``shift``."""
    if len(values):
        top = values >> np.uint64(shift)
        starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
            yield int(top[a]), slice(a, b)


def _squeeze(numbers: np.ndarray) -> bytes:
    import zstandard

    size = numbers.itemsize
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, size).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(data: bytes, kind: str, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def _ask_sketch(batches: Iterator[pa.RecordBatch], window: int, range_bits: int,
                cell_bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's part of the sketch: per row and range the cells it touches, and which of them twice."""
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts = _Texts(packed.as_py(), window)
            rows = []
            for depth in range(DEPTH):
                cells, where, counts = np.unique(_cells(texts.hashes, depth, cell_bits),
                                                 return_inverse=True, return_counts=True)
                twice = counts > 1
                twice[where[texts.twice]] = True
                for part, some in _by_range(cells, cell_bits - range_bits):
                    steps = np.diff(cells[some], prepend=np.uint64(part << cell_bits - range_bits))
                    bits = np.packbits(twice[some])
                    rows.append((chunk, depth << range_bits | part, len(steps),
                                 len(bits).to_bytes(8, "little") + bits.tobytes() + _squeeze(steps)))
            rows.append((chunk, -1 - chunk, 0, b""))  # every chunk gets an answer
            yield pa.RecordBatch.from_pydict(_parts(rows))


def _merge(asked: pa.Table, bits_below: int) -> pa.Table:
    """Which cells of one range of the merged sketch count two or more, for each chunk that asked."""
    chunks, parts, sizes = (asked.column(c).to_pylist() for c in ("chunk", "part", "n"))
    if parts[0] < 0:
        return asked
    packed = asked.column("packed").to_pylist()
    offsets, weights = [], []
    for n, data in zip(sizes, packed):
        held = int.from_bytes(data[:8], "little")
        twice = np.unpackbits(np.frombuffer(data[8:8 + held], np.uint8), count=n)
        offsets.append(np.cumsum(_expand(data[8 + held:], "<u8", n)).astype(np.int64))
        weights.append(1 + twice)
    every = np.concatenate(offsets)
    cells, where = np.unique(every, return_inverse=True)
    often = np.bincount(where, np.concatenate(weights), len(cells)) >= 2
    ends = np.cumsum(sizes)
    return pa.table(_parts([
        (chunk, part, n, np.packbits(often[where[end - n:end]]).tobytes())
        for chunk, part, n, end in zip(chunks, parts, sizes, ends.tolist())]))


def _bits(parts: dict[int, tuple[int, bytes]], numbers: list[int]) -> np.ndarray:
    """The answers of several ranges, one after the other."""
    some = [np.unpackbits(np.frombuffer(parts[p][1], np.uint8), count=parts[p][0]) for p in numbers]
    return np.concatenate(some).astype(bool) if some else np.zeros(0, bool)


def _open(texts: pa.Table, answers: pa.Table, window: int) -> tuple[int, _Texts, dict]:
    parts = {p: (n, data) for p, n, data in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "packed")))}
    return texts.column("chunk")[0].as_py(), _Texts(texts.column("texts")[0].as_py(), window), parts


def _ask_exact(texts: pa.Table, answers: pa.Table, window: int, range_bits: int, cell_bits: int) -> pa.Table:
    """The windows that the sketch takes for repeated, with longer hashes, to the exact groups."""
    chunk, opened, parts = _open(texts, answers, window)
    chosen = np.ones(len(opened.hashes), bool)
    for depth in range(DEPTH):
        cells, where = np.unique(_cells(opened.hashes, depth, cell_bits), return_inverse=True)
        often = _bits(parts, sorted(p for p in parts if p >= 0 and p >> range_bits == depth))
        chosen &= often[where]
    numbers = np.flatnonzero(chosen)
    hashes, more = opened.hashes[numbers], opened.longer(numbers, window) if len(numbers) else np.zeros(0, np.uint32)
    rows = [(chunk, -1 - chunk, len(chosen), np.packbits(chosen).tobytes())]
    for part, some in _by_range(hashes, 64 - range_bits):
        rows.append((chunk, part, some.stop - some.start, hashes[some].tobytes() + more[some].tobytes()
                     + np.packbits(opened.twice[numbers[some]]).tobytes()))
    return pa.table(_parts(rows))


def _group(asked: pa.Table) -> pa.Table:
    """Which windows of one range of hashes occur twice or more, for each chunk that asked."""
    chunks, parts, sizes = (asked.column(c).to_pylist() for c in ("chunk", "part", "n"))
    if parts[0] < 0:
        return asked
    hashes, more, weights = [], [], []
    for n, data in zip(sizes, asked.column("packed").to_pylist()):
        hashes.append(np.frombuffer(data, "<u8", n))
        more.append(np.frombuffer(data, "<u4", n, 8 * n))
        weights.append(1 + np.unpackbits(np.frombuffer(data[12 * n:], np.uint8), count=n))
    hashes, more, weights = np.concatenate(hashes), np.concatenate(more), np.concatenate(weights)
    order = np.lexsort((more, hashes))
    a, b = hashes[order], more[order]
    group = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    repeated = np.empty(len(order), bool)
    repeated[order] = (np.bincount(group, weights[order]) >= 2)[group]
    ends = np.cumsum(sizes)
    return pa.table(_parts([(chunk, part, n, np.packbits(repeated[end - n:end]).tobytes())
                            for chunk, part, n, end in zip(chunks, parts, sizes, ends.tolist())]))


def _remove(texts: pa.Table, answers: pa.Table, window: int, schema: T.StructType) -> pa.Table:
    chunk, opened, parts = _open(texts, answers, window)
    n, data = parts.pop(-1 - chunk)
    chosen = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    repeated = np.zeros(n, bool)
    repeated[chosen] = _bits(parts, sorted(parts))
    starts = opened.at[repeated[opened.index]] if n else opened.at
    edge = np.zeros(len(opened.words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(opened.words)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept, removed = [], []
    for a, b in zip(opened.starts[:-1], opened.starts[1:]):
        mask = gone[a:b]
        removed.append(int(mask.sum()))
        words = opened.words[a:b]
        kept.append(b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if removed[-1] else words).decode())
    sizes = np.diff(opened.starts)
    rows = texts.column("rows").combine_chunks().flatten()
    return pa.table({"row": rows, "n_words": pa.array(sizes, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})
