"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netpen import session

# White space between words: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"


# Rows come in bounded batches to Python, whatever the length of their texts.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """The library's session settings and those of this package."""
    for name, value in ARROW_SETTINGS.items():
        spark.conf.set(name, value)
    return session.configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of characters other than ASCII white space; null has none.

    Splitting leaves an empty first or last entry where the text starts or ends with white space.
    """
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def nullable(kind: T.DataType) -> T.DataType:
    """The type with every field of a struct allowed to be null, as Arrow results have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def width(df: DataFrame, least: int = 1) -> int:
    """Shuffle width of the session, for repartitioning by a key."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
