"""Observation CSV files: physical lines, header check, checksums, files already imported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netpen.functions.text import OBS_HEADER, csv_fields, is_blank, jtrim
from netpen.operators.hot import OrderedScan, line_chunk
from netpen.operators.latest import compute_once
from netpen.session import stage

# Fixed value: SHA-256 of no bytes.
EMPTY_CHECKSUM = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# Stands for an expectation that has not come; no checksum equals it.
NO_EXPECTATION = "(none)"


def scan_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per file: file_path, file_time, length and the SHA-256 of its bytes.

    Bytes are read for the checksum alone and go no further; a file beyond what Spark's binary source
    can hold (2 GB) raises. The source passes over files without bytes; they come from its listing.
    """
    files = _binary(spark, path)
    found = stage(with_checksum(files), "file-checksums")
    return found.unionByName(empty_files(spark, path, found))


def _binary(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        path if isinstance(path, str) else list(path))


def empty_files(spark: SparkSession, path: str | Sequence[str], found: DataFrame | None = None) -> DataFrame:
    """Rows as of ``scan_files`` for the listed files that the source holds no row of; no bytes are read."""
    files = _binary(spark, path)
    # The listing is the driver's own; only its names are used.
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "file_path string")
    if found is None:
        found = files.select(F.input_file_name().alias("file_path"), "length").where("length > 0")
    return listed.join(found.select("file_path"), "file_path", "left_anti").select(
        "file_path", F.lit(None).cast("timestamp_ntz").alias("file_time"),
        F.lit(0).cast("bigint").alias("length"), F.lit(EMPTY_CHECKSUM).alias("checksum"))


def with_checksum(files: DataFrame, *more: str | Column) -> DataFrame:
    """File rows of a ``binaryFile`` scan or stream, and ``more`` of its columns."""
    return files.select(
        *more,
        F.input_file_name().alias("file_path"),
        F.col("modificationTime").cast("timestamp_ntz").alias("file_time"),
        "length", F.sha2("content", 256).alias("checksum"))


def verify_checksum(files: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split by (file_path, expected_checksum); a blank expectation accepts the file, and so does any that fits."""
    wanted = F.col("expected_checksum")
    joined = files.join(expected.select("file_path", "expected_checksum").distinct(), "file_path", "left").withColumn(
        "fits", is_blank(wanted) | (F.lower(jtrim(wanted)) == F.col("checksum")))
    good = joined.where("fits").drop("fits", "expected_checksum").distinct()
    return good, joined.where("not fits").join(good.select("file_path"), "file_path", "left_anti").groupBy(
        "file_path", "checksum").agg(F.min("expected_checksum").alias("expected_checksum"))


def dedup_files(files: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Files not imported before, and of equal files the earliest one."""
    order = F.struct("file_time", "file_path")
    keep = files.groupBy("checksum").agg(F.min(order).alias("keep")).select(
        "checksum", F.col("keep.file_path").alias("file_path"), F.col("keep.file_time").alias("file_time"))
    return keep if ledger is None else keep.join(ledger.select("checksum"), "checksum", "left_anti")


def read_obs_files(spark: SparkSession, path: str | Sequence[str], files: DataFrame,
                   hot_rows: int | None = None) -> DataFrame:
    """Physical lines of ``files``: checksum, file_path, file_time, line_no from 1, raw_line.

    Lines end with CR, LF or both. Files are split between tasks like any text; a line's number is the count of
    lines before it by (start of its split, place in the split), so no task needs a whole file.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path))
    lines = text.select(
        F.input_file_name().alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.expr("make_valid_utf8(value)").alias("raw_line"))
    # Written before it is counted: places must not be dealt out a second time.
    lines = stage(lines.join(files.select("file_path", "file_time", "checksum"), "file_path"), "file-lines")
    scan = OrderedScan(lines, ["checksum"], ["block", "place"], F.col("block"), hot_rows)
    return scan.carry(count="before").rows().select(
        "checksum", "file_path", "file_time", (F.col("before") + 1).alias("line_no"), "raw_line")


def judge_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The files with ``file_error``: null, ``bad_header`` or ``no_data_rows``."""
    header = csv_fields(F.regexp_replace("raw_line", r"^\x{FEFF}", ""))
    expected = F.array(*[F.lit(name) for name in OBS_HEADER])
    heads = lines.where("line_no = 1").select("checksum", (header == expected).alias("header_ok"))
    data = lines.where((F.col("line_no") > 1) & ~is_blank(F.col("raw_line"))).groupBy("checksum").agg(
        F.count(F.lit(1)).alias("data_rows"))
    return files.join(heads, "checksum", "left").join(data, "checksum", "left").withColumn(
        "file_error", F.when(~F.coalesce("header_ok", F.lit(False)), "bad_header")
        .when(F.col("data_rows").isNull(), "no_data_rows")).drop("header_ok", "data_rows")


def data_lines(judged: DataFrame, lines: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Numbered data lines of sound files: checksum, file_path, file_time, line_no, data_idx, raw_line."""
    sound = judged.where(F.col("file_error").isNull()).select("checksum")
    return number_data_lines(lines.where("line_no > 1").join(sound, "checksum", "left_semi"), hot_rows).select(
        "checksum", "file_path", "file_time", "line_no", "data_idx", "raw_line")


def drop_blank(lines: DataFrame) -> DataFrame:
    # The line may be an expression itself: the filter would be pushed below it and form it twice.
    formed = compute_once(lines.withColumnRenamed("raw_line", "__line"), F.col("__line").alias("raw_line"))
    return formed.where(~is_blank(F.col("raw_line"))).select(*lines.columns)


def number_data_lines(lines: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``data_idx`` for numbered lines: the data lines before each of them."""
    # Written once: the look for long files, the counts of their pieces and the scan each read it.
    written = stage(drop_blank(lines), "written-lines")
    scan = OrderedScan(written, ["checksum"], ["line_no"], line_chunk(F.col("line_no")), hot_rows)
    return scan.carry(count="data_idx").rows()
