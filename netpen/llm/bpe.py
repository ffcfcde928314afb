"""Byte-level BPE over a distinct-word table, and decoding through the id-to-piece table.

Texts are split into words in the JVM. Each chunk of rows replaces its words by codes into the
chunk's own dictionary, so only a chunk's distinct words leave it, packed into one row per shard of
the word's hash. A shard holds every occurrence of its words in any dictionary: it forms their
distinct-word table, encodes each word once and returns the ids to the dictionaries; each chunk puts
its rows together by position. No text and no row per word occurrence is shuffled.

A chunk holds at most ``CHUNK_WORDS`` words or one row. A frequent word has one entry per chunk, so no
word's group grows with its occurrences. There are two shards per shuffle partition of the session.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from netpen.llm.common import nullable, width

# The split pattern of the vocabulary's byte-level pre-tokenizer.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK_WORDS = 1_500_000
SHARDS_PER_PARTITION = 2


def read_vocabulary(path: str) -> str:
    """The tokenizer file's JSON text; refuses kinds that split or rewrite text in another way."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    kind = json.loads(text)
    split = kind["pre_tokenizer"] or {}
    if (kind["normalizer"] is not None or split.get("type") != "ByteLevel" or split["add_prefix_space"]
            or not split.get("use_regex", True) or kind["model"]["type"] != "BPE"
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"])):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    return text


def added_tokens(vocabulary: str) -> list[str]:
    return [t["content"] for t in json.loads(vocabulary)["added_tokens"]]


def load(shared: dict):
    """The tokenizer of a broadcast ``{"json": text}``, built once per Python worker."""
    if "tokenizer" not in shared:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared["json"])
        tokenizer.no_truncation()
        tokenizer.no_padding()
        shared["tokenizer"] = tokenizer
    return shared["tokenizer"]


def piece_bytes(vocabulary: str) -> list[bytes | None]:
    """The bytes of each id; None where the vocabulary leaves an id free."""
    kind = json.loads(vocabulary)
    # The byte-level alphabet: printable Latin-1 characters stand for themselves, the other
    # bytes for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def raw(piece: str) -> bytes:
        if all(c in byte_of for c in piece):
            return bytes(byte_of[c] for c in piece)
        return piece.encode()

    ids = dict(kind["model"]["vocab"]) | {t["content"]: t["id"] for t in kind["added_tokens"]}
    table: list[bytes | None] = [None] * (max(ids.values(), default=-1) + 1)
    for piece, number in ids.items():
        table[number] = raw(piece)
    return table


def encode(docs: DataFrame, vocabulary: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the ``keep`` columns (all but the text) and ``ids``, little-endian
    unsigned 32-bit integers, equal to the tokenizers library's for the whole text without special
    tokens added.

    Null and empty texts give no ids. Repeated rows stay repeated. An empty table gives an empty one.
    Columns of any name may be kept, save that ``ids`` would be ambiguous and raises.

    The input is read twice, for the texts' codes and for the chunks' words, which costs less than to
    write both in between. It must give its rows in the same order both times, as files do; if not,
    the chunks' digests differ and the job fails.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if "ids" in keep:
        raise ValueError("a kept column is named ids")
    # One struct holds the kept columns, so their names clash with nothing below.
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int"))
    rows = docs.select(kept.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = _split(rows, vocabulary, "texts")
    shards = _split(rows, vocabulary, "words")
    entries = _encode_words(shards, vocabulary)
    out = T.StructType([T.StructField("row", nullable(rows.schema["row"].dataType)),
                        T.StructField("ids", T.BinaryType())])
    joined = texts.groupBy("chunk").cogroup(
        entries.withColumnRenamed("chunk", "of_chunk").groupBy("of_chunk")).applyInArrow(_assemble, out)
    return joined.select(*[F.col("row")[c].alias(c) for c in keep], "ids")


def _split(rows: DataFrame, vocabulary: str, wanted: str) -> DataFrame:
    """``texts``: each row with its text as codes. ``words``: each chunk's dictionary words by shard, and as
    shard -1 the shard of each code. Both carry the digest of the chunk's dictionary.

    Java knows an older Unicode version than the library: a text with a character that Java has as
    unassigned, or with an added token, is split by the library itself.
    """
    special = "|".join(["\\p{Cn}", *[f"\\Q{t}\\E" for t in added_tokens(vocabulary)]])
    plain = ~F.col("text").rlike(special)
    rows = rows.select(
        "row",
        F.when(plain, F.regexp_extract_all("text", F.lit(f"(?U)({WORD_PATTERN})"), 1)).alias("words"),
        F.when(~plain, F.col("text")).alias("text"))
    source = rows.sparkSession.sparkContext.broadcast({"json": vocabulary})  # a fixed file of 2 MB
    row_type = nullable(rows.schema["row"].dataType)
    n_shards = SHARDS_PER_PARTITION * width(rows)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part_row, part_words in _gather(_words(batches, source.value)):
            for one_row, one_words in _cut(part_row, part_words):
                yield from _chunk(number, one_row, one_words, n_shards, wanted)
                number += 1

    content = T.StructField("row", row_type) if wanted == "texts" else T.StructField("shard", T.IntegerType())
    return rows.mapInArrow(chunks, T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("digest", T.LongType()), content,
        T.StructField("packed", T.BinaryType())]))


def _words(batches: Iterator[pa.RecordBatch], shared: dict) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows and their words; texts that came whole are split by the library."""
    for batch in batches:
        row, words, text = (batch.column(i) for i in range(3))
        odd = np.asarray(text.is_valid())
        if not odd.any():
            yield row, words
            continue
        yield row.filter(pa.array(~odd)), words.filter(pa.array(~odd))
        split = [_library_words(t.as_py(), load(shared)) for t in text.filter(pa.array(odd))]
        yield row.filter(pa.array(odd)), pa.array(split, pa.list_(pa.string()))


def _gather(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Parts put together until they have a chunk's words."""
    held, size = [], 0
    for row, words in parts:
        held.append((row, words.cast(pa.list_(pa.string()))))
        size += words.offsets[-1].as_py() - words.offsets[0].as_py()
        if size >= CHUNK_WORDS:
            yield tuple(pa.concat_arrays(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays(c) for c in zip(*held))


def _library_words(text: str, tokenizer) -> list[str]:
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words: list[str] = []
    rest = text
    while rest:
        # The first added token; of several at one place the longest.
        found = min(((rest.find(t), -len(t), t) for t in special if t in rest), default=None)
        head = rest if found is None else rest[:found[0]]
        words += [head[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(head)]
        if found is None:
            break
        words.append(found[2])
        rest = rest[found[0] + len(found[2]):]
    return words


def _cut(row: pa.Array, words: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    ends = words.offsets.to_numpy().astype(np.int64)
    first = 0
    while first < len(row):
        last = int(np.searchsorted(ends, ends[first] + CHUNK_WORDS, side="right")) - 1
        last = min(max(last, first + 1), len(row))
        yield row.slice(first, last - first), words.slice(first, last - first)
        first = last


def _pack(values: np.ndarray, data: bytes = b"") -> bytes:
    """Numbers, byte by byte so that they compress, then bytes."""
    import zstandard

    size = values.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()
    head = np.array([size, len(values)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + planes + data)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    size, count = np.frombuffer(raw, "<i8", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, size * count, 16).reshape(size, -1).T
    return np.ascontiguousarray(planes).view(f"<u{size}").ravel(), raw[16 + size * count:]


def _chunk(number: int, row: pa.Array, words: pa.Array, n_shards: int, wanted: str) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh32_intdigest, xxh64_intdigest

    flat = words.flatten().dictionary_encode()
    index = flat.indices.to_numpy()
    # Frequent words get small codes, which compress well.
    order = np.argsort(-np.bincount(index, minlength=len(flat.dictionary)), kind="stable")
    names = flat.dictionary.take(pa.array(order)).cast(pa.binary())
    digest = xxh64_intdigest(b"".join(memoryview(b) for b in names.buffers()[1:] if b is not None)) >> 1
    if wanted == "texts":
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        codes = rank[index].astype(np.uint16 if len(order) <= 1 << 16 else np.uint32)
        ends = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        content, packed = row, [_pack(codes[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    else:
        names = names.to_pylist()
        shard = np.array([xxh32_intdigest(w) for w in names], np.int64) % n_shards
        by_shard = np.argsort(shard, kind="stable")
        numbers, starts = np.unique(shard[by_shard], return_index=True)
        packed = [_pack(shard.astype(np.uint32))]
        for part in np.split(by_shard, starts[1:]) if len(names) else []:
            some = [names[i] for i in part]
            packed.append(_pack(np.array([len(w) for w in some], np.uint32), b"".join(some)))
        content = pa.array([-1, *numbers.tolist()], pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(content), number)), pa.array(np.full(len(content), digest, np.int64)), content,
         pa.array(packed, pa.binary())], ["chunk", "digest", "row" if wanted == "texts" else "shard", "packed"])


def _encode_words(shards: DataFrame, vocabulary: str) -> DataFrame:
    """The ids of each chunk's words of a shard, every distinct word of the shard encoded once."""
    source = shards.sparkSession.sparkContext.broadcast({"json": vocabulary})

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("shard")[0].as_py() < 0:  # the shards of the codes: no words
            return rows
        of_chunk, numbers = [], {}
        for packed in rows.column("packed"):
            lengths, data = _unpack(packed.as_py())
            ends = np.cumsum(lengths).tolist()
            of_chunk.append([numbers.setdefault(data[a:b], len(numbers))
                             for a, b in zip([0, *ends[:-1]], ends)])
        found = load(source.value).encode_batch([w.decode() for w in numbers], add_special_tokens=False)
        ids = [np.array(e.ids, "<u4").tobytes() for e in found]
        sizes = np.array([len(i) // 4 for i in ids], np.uint32)
        packed = []
        for words in of_chunk:
            flat = np.frombuffer(b"".join([ids[w] for w in words]), "<u4")
            packed.append(_pack(np.concatenate([sizes[words], flat])))
        return pa.table({"chunk": rows.column("chunk"), "digest": rows.column("digest"),
                         "shard": rows.column("shard"), "packed": pa.array(packed, pa.binary())})

    # The rows of shard -1 go each their own way.
    apart = F.when(F.col("shard") < 0, -1 - F.col("chunk")).otherwise(F.col("shard").cast("long"))
    return shards.groupBy(apart.alias("part")).applyInArrow(
        run, "chunk long, digest long, shard int, packed binary")


def _assemble(texts: pa.Table, entries: pa.Table) -> pa.Table:
    """The ids of a chunk's rows: the dictionary's ids taken by position."""
    if len({*texts.column("digest").to_pylist(), *entries.column("digest").to_pylist()}) > 1 or not len(entries):
        raise ValueError("the input gave its rows in another order the second time")
    if not len(texts):
        raise ValueError("the input gave other rows the second time")
    parts = dict(zip(entries.column("shard").to_pylist(), entries.column("packed")))
    sizes, flat = np.zeros(0, np.int64), [np.zeros(0, "<u4")]
    shard = _unpack(parts.pop(-1).as_py())[0]
    if parts:
        by_shard = np.argsort(shard, kind="stable")
        counts = np.bincount(shard)
        lengths = []
        for number in sorted(parts):
            numbers = _unpack(parts[number].as_py())[0]
            lengths.append(numbers[:counts[number]])
            flat.append(numbers[counts[number]:])
        lengths = np.concatenate(lengths).astype(np.int64)
        sizes, starts = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
        sizes[by_shard], starts[by_shard] = lengths, np.cumsum(lengths) - lengths
    flat = np.concatenate(flat)
    ids = []
    for packed in texts.column("packed"):
        codes = _unpack(packed.as_py())[0]
        if not len(codes):
            ids.append(b"")
            continue
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        ids.append(flat[np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - lengths), lengths)].tobytes())
    return pa.table({"row": texts.column("row"), "ids": pa.array(ids, pa.binary())})


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace ``ids`` by the text ``out``, equal to the library's decode with special tokens kept.

    The id-to-piece table has one row per vocabulary entry, a fixed bound, and goes to every task;
    ids join it by their number. Ids outside the vocabulary add nothing, null ids give an empty
    text, bytes that are not UTF-8 give replacement characters.
    """
    keep = [c for c in encoded.columns if c != ids]
    if out in keep:
        raise ValueError(f"a column is already named {out}")
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_bytes(vocabulary))
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_")).alias("row"),
                          F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([p or b"" for p in pieces.value], dtype=object)
        for batch in batches:
            texts = []
            for one in batch.column(1):
                numbers = np.frombuffer(one.as_py() or b"", "<u4")
                numbers = numbers[numbers < len(table)]
                texts.append(b"".join(table[numbers]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             ["row", "text"])

    return rows.mapInArrow(run, schema).select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("text").alias(out))
