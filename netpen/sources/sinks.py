"""Writing results: upserts, whole-day replacement, append-only events, row ledgers.

Upserts and replacements are published as whole versions, see ``versions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from netpen.operators.latest import first_per_key
from netpen.schemas import CAGE_OBSERVATION, TABLES
from netpen.session import PARTITION_OVERWRITE
from netpen.sources.tables import conform
from netpen.sources.versions import Version, change, day_of, days_of, open_version

OBSERVATION_KEY = ["voyage_no", "cage_no", "observed_at"]


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the changes: a change's non-null fields win, absent ones are kept.

    Both sides hold at most one row per key.
    """
    values = [c for c in current.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values if c in changes.columns])
    merged = current.join(new, list(keys), "full")
    return merged.select(*keys, *[
        (F.coalesce(f"__new_{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in values])


def upsert_observations(current: DataFrame, changes: DataFrame) -> DataFrame:
    after = upsert(current, changes, OBSERVATION_KEY)
    return after.select(*[f.name for f in CAGE_OBSERVATION])


def replace_results(existing: DataFrame, new: DataFrame,
                    pairs: DataFrame | None = None) -> DataFrame:
    """Results with every recalculated (batch, business date) replaced as a whole.

    ``pairs`` names the recalculated days where ``new`` may hold no row for some, as for details.
    """
    keys = ["batch_id", "business_date"]
    done = (new if pairs is None else pairs).select(*keys).distinct()
    return existing.join(done, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New events whose number and whose (chain, seq) are both unused, in the table and the run."""
    order = ["migration_no", "chain_no", "seq_no"]
    fresh = (
        new.join(existing.select("migration_no"), "migration_no", "left_anti")
        .join(existing.select("chain_no", "seq_no"), ["chain_no", "seq_no"], "left_anti"))
    fresh = first_per_key(fresh, ["migration_no"], order, "first_no").where("first_no")
    fresh = first_per_key(fresh, ["chain_no", "seq_no"], order, "first_seq").where("first_seq")
    return fresh.select(*new.columns)


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace exactly the partitions ``df`` has rows for; others stay untouched."""
    df.write.mode("overwrite").options(**PARTITION_OVERWRITE).partitionBy(*by).parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Row ledger partitioned by file: importing a file again replaces its rows."""
    write_partitions(ledger, path, ["checksum"])


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert_table(spark: SparkSession, path: str, name: str, changes: DataFrame,
                 keys: Sequence[str], time: str, locked: Column | None = None) -> None:
    """Upsert into a published table filed by the day of column ``time`` and bucketed by ``keys``.

    Stored rows for which ``locked`` holds keep their values, whatever the changes say of them.

    Only the days that change are read and written, the stored side without a shuffle; readers see all of
    it or nothing. Applying the same changes again gives the same table, so a run that was cut off may
    simply be repeated.
    """
    schema = TABLES[name]
    changes = changes.withColumn("day", day_of(time))
    days = days_of(changes)

    def build(version: Version) -> tuple[DataFrame, Sequence] | None:
        if not days:
            return None
        affected = open_version(spark, path, schema, version).where(F.col("day").isin(days)).drop("day")
        given = changes.drop("day")
        if locked is not None:
            given = given.join(affected.where(locked).select(*keys), list(keys), "left_anti")
        after = conform(upsert(affected, given, keys), schema)
        return after.withColumn("day", day_of(time)), days

    change(spark, path, keys, build)


def replace_table(spark: SparkSession, path: str, new: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> None:
    """Replace all rows of the given (batch_id, business_date) pairs in a published table filed by date.

    ``keys`` name the buckets; take columns without heavy values. Dates that lose their last row are gone.
    """
    days = days_of(pairs.select(F.col("business_date").alias("day")))

    def build(version: Version) -> tuple[DataFrame, Sequence] | None:
        if not days:
            return None
        current = open_version(spark, path, new.schema, version).where(F.col("day").isin(days)).drop("day")
        after = replace_results(current, new.select(*current.columns), pairs)
        return after.withColumn("day", F.col("business_date")), days

    change(spark, path, keys, build)
