"""Typed scans of the entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from netpen.schemas import TABLES


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """Lazy scans with fixed schemas; only the columns and row groups a job needs are read."""
    return {name: load_table(spark, root, name) for name in names or TABLES}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order and types; absent ones as null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema])
