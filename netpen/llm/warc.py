"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading them back.

``write_archives`` turns pages into records of gzipped archive files, which Spark's text writer writes
with the records' own terminator between them. ``read_archives`` reads such files record by record;
no file is held as a whole. Segments of a record are grouped by the origin's identifier, ordered by
their number, and their total length is verified; then the transfer framing is decoded and the
payload's digest verified. Damaged archives raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from netpen.session import stage

# Fixed values of the format.
VERSION = b"WARC/1.0\r\n"
RECORD_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_column: str = "page_id",
                   url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archives below ``path`` with a record per row; the payload is the html in UTF-8 (null: empty).

    Of the rows with equal payloads of ``min_bytes`` or more, those with the smallest id are responses, the
    others revisits of it; smaller payloads are all responses. Null ids come last: they revisit a row
    with an id, and are responses if there is none. Rows repeated as a whole are all responses or
    all revisits. An empty table gives archives without records.
    """
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # Only payloads that occur twice need to know their first page.
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = rows.join(stage(first.select("sha1", "first"), "payload-firsts"), "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                records = [r for row in some for r in records_of(*row, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("lineSep", RECORD_END.decode()).text(path))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[tuple]]:
    """A batch's rows as tuples, a few at a time."""
    for start in range(0, len(batch), rows):
        yield list(zip(*[c.to_pylist() for c in batch.slice(start, rows).columns]))


def records_of(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None,
               segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of a page, without their terminators: one, or a first and continuations."""
    identifier = f"<urn:uuid:{uuid.uuid4()}>"
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = {"WARC-Record-ID": identifier, "WARC-Date": "1970-01-01T00:00:00Z",
              "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest}
    if url is not None:
        fields["WARC-Target-URI"] = " ".join(url.split())
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    if refers_to is not None:
        return [_record(fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE,
                                  "Refers-To-Page-ID": str(refers_to)}, b"HTTP/1.1 200 OK\r\n\r\n")]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + frame(payload, chunk_bytes))
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record(fields | {"WARC-Type": "response"}, block)]
    records = [_record(fields | {"WARC-Type": "response", "WARC-Segment-Number": "1"}, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": identifier,
                "WARC-Segment-Number": str(number)}
        if number == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        records.append(_record(more, part))
    return records


def _record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return VERSION + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def frame(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in [*parts, b""])


def unframe(data: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2:end + 2 + size])
        at = end + 2 + size + 2
        if len(out[-1]) != size or data[at - 2:at] != b"\r\n":
            raise ValueError("a chunk is cut short")


RECORDS = ("record_id string, page_id long, url string, record_type string, refers_to long, digest string, "
           "segment int, total long, block binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type (response or revisit), refers_to, payload_digest and payload per record.

    The payload of a revisit is null. Archives are gzipped files, which Spark reads from start to end in
    one task each, a record at a time.
    """
    kept = "page_id", "url", "record_type", "refers_to", "digest"
    whole = _records(spark, path, False).select(*kept, "block")
    parts = _records(spark, path, True)
    joined = parts.groupBy("record_id").applyInArrow(
        lambda group: _join_segments(group), "page_id long, url string, record_type string, refers_to long, "
        "digest string, block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                rows = [(*row[:4], *payload_of(row[2], row[4], row[5])) for row in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _PAYLOAD_TYPES)], _PAYLOAD_NAMES)

    return whole.unionByName(joined).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


_PAYLOAD_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"]
_PAYLOAD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def payload_of(kind: str, digest: str, block: bytes) -> tuple[str, bytes | None]:
    """The digest and, but for revisits, the payload of an HTTP block."""
    if kind == "revisit":
        return digest, None
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unframe(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest is not None and digest != found:
        raise ValueError("a payload does not match its digest")
    return found, payload


def _records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The parsed records: those in segments, or the others."""
    pieces = spark.read.option("lineSep", VERSION.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, row = None, b"", None

        def done() -> list[tuple]:
            if held and row is None:
                raise ValueError(f"{at}: a record is cut short")
            return [row] if held and (row[6] is not None) == segmented else []

        for batch in batches:
            for some in _slices(batch):
                rows = []
                for file, piece in some:
                    # The version line within a block is no record's start: the piece before it is short.
                    if file == at and held and row is None:
                        held += VERSION + piece
                    else:
                        rows += done()
                        at, held = file, piece
                    row = parse(held) if held else None
                yield _batch(rows)
        yield _batch(done())

    return pieces.mapInArrow(run, RECORDS)


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(),
          pa.binary()]
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def parse(record: bytes) -> tuple | None:
    """A record (without its version line) as a row; None if it is cut short."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length")
    if not mark or size is None or len(rest) < int(size):
        return None
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields.get("warc-payload-digest")
    return (fields.get("warc-segment-origin-id", fields["warc-record-id"]), number("page-id"),
            fields.get("warc-target-uri"), fields["warc-type"], number("refers-to-page-id"),
            digest and digest.partition(":")[2], number("warc-segment-number"),
            number("warc-segment-total-length"), rest[:int(size)])


def _join_segments(group: pa.Table) -> pa.Table:
    """A record's segments in order, as one block; a group holds no more than one record."""
    rows = sorted(group.to_pylist(), key=lambda r: r["segment"])
    block = b"".join(r["block"] for r in rows)
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
        raise ValueError(f"{rows[0]['record_id']}: segments are missing")
    first = rows[0] | {"block": block}
    return pa.table({n: pa.array([first[n]], t) for n, t in zip(_NAMES, _TYPES)
                     if n not in ("record_id", "segment", "total")})
