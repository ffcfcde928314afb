"""Tables published as a whole: bucketed by key, one folder a day and version, one small pointer that names them.

A version is written into a new folder; only then is a pointer put in place that maps every day to the folder
that holds it. Readers take the newest pointer, so they see all of a version or none of it, and a day that lost
its last row is simply no longer named. A write that was cut off leaves a folder nobody reads. Days that do not
change keep their folders. A pointer's place is its number and is taken once, by a rename: of writers that started
from the same version one wins, the others compute their change anew on what it left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from netpen.session import delete_path

POINTER = "version long, buckets int, keys array<string>, columns string, day date, folder string"
PARTITIONS_A_STATEMENT = 500
ATTEMPTS = 8
NO_DAY = "1900-01-01"


class Overtaken(Exception):
    """Another writer has published since the version that the change was computed from."""


class Version:
    """A published state: number, bucket count, keys, columns, and folder per day (calendar days only)."""

    def __init__(self, spark: SparkSession, path: str):
        pointers = _pointers(spark, path)
        rows = pointers.where(F.col("version") == pointers.agg(F.max("version")).scalar()).collect()
        self.number = rows[0]["version"] if rows else 0
        self.buckets = rows[0]["buckets"] if rows else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = rows[0]["keys"] if rows else []
        self.columns = rows[0]["columns"] if rows else ""
        self.folders = {row.day: row.folder for row in rows if row.day is not None}


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/pointer")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def day_of(time: str) -> Column:
    """The day a row is filed under; rows without a time share one day."""
    return F.coalesce(F.to_date(time), F.lit(NO_DAY).cast("date"))


def days_of(df: DataFrame) -> list:
    """Distinct values of ``day``: calendar days, so a few thousand at most."""
    return [row.day for row in df.select("day").distinct().collect()]


def open_version(spark: SparkSession, path: str, schema: StructType | None = None,
                 version: Version | None = None) -> DataFrame:
    """The newest (or given) version, with its column ``day``; no rows of ``schema`` where nothing is published.

    Filters on ``day`` prune folders, and joins or groups on the table's keys do not shuffle it. It is an external
    table of the session's catalog named by its content, so a DataFrame keeps reading the version it was opened on.
    """
    version = Version(spark, path) if version is None else version
    if not version.folders:
        columns = version.columns or StructType(schema.fields).toDDL()
        return spark.createDataFrame([], f"{columns}, day date")
    content = repr((path, version.columns, sorted(version.folders.items())))
    name = f"netpen_{hashlib.sha256(content.encode()).hexdigest()[:24]}"
    keys = ", ".join(f"`{key}`" for key in version.keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({version.columns}, day DATE) USING parquet PARTITIONED BY (day) "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {version.buckets} BUCKETS LOCATION '{path}/data'")
    days = sorted(version.folders.items())
    for at in range(0, len(days), PARTITIONS_A_STATEMENT):
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(
            f"PARTITION (day = DATE'{day}') LOCATION '{path}/{folder}/day={day}'"
            for day, folder in days[at:at + PARTITIONS_A_STATEMENT]))
    return spark.table(name)


def publish(spark: SparkSession, path: str, after: DataFrame, keys: Sequence[str], days: Sequence,
            version: Version) -> None:
    """The next version: ``days`` hold what ``after`` (with a column ``day``) has for them, all others stay.

    ``version`` is the one that ``after`` was computed from; if it is no longer the newest, ``Overtaken`` is raised
    and nothing has changed.
    """
    folder, name = f"data/{uuid.uuid4().hex}", f"netpen_{uuid.uuid4().hex}"
    keys = version.keys or list(keys)
    (after.repartition(version.buckets, *keys).write.format("parquet").partitionBy("day")
     .bucketBy(version.buckets, *keys).sortBy(*keys).option("path", f"{path}/{folder}").saveAsTable(name))
    written = days_of(spark.table(name))
    # Its files belong to the version now; only the name goes.
    spark.sql(f"DROP TABLE {name}")
    replaced = set(days) | set(written)
    folders = {day: at for day, at in version.folders.items() if day not in replaced}
    folders |= {day: folder for day in written}
    columns = version.columns or StructType([f for f in after.schema if f.name != "day"]).toDDL().replace(
        " NOT NULL", "")
    _point(spark, path, [(version.number + 1, version.buckets, keys, columns, day, at)
                         for day, at in folders.items() or [(None, None)]])


def _point(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Put the pointer in its place unless that is taken."""
    written, place = f"{path}/pointers-written/{uuid.uuid4().hex}", f"{path}/pointer/number={rows[0][0]}"
    spark.createDataFrame(rows, POINTER).coalesce(1).write.parquet(written)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(written), hadoop.Path(place)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    # A file context's rename refuses an existing target.
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(source), files.makeQualified(target),
                       spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as refused:
        if not files.exists(target):
            raise
        files.delete(source, True)
        raise Overtaken(place) from refused


def change(spark: SparkSession, path: str, keys: Sequence[str],
           build: Callable[[Version], tuple[DataFrame, Sequence] | None]) -> None:
    """Publish what ``build`` makes of the newest version (rows and the days they replace; None: nothing to do)."""
    for attempt in range(ATTEMPTS):
        version = Version(spark, path)
        built = build(version)
        if built is None:
            return
        try:
            return publish(spark, path, built[0], keys, built[1], version)
        except Overtaken:
            if attempt == ATTEMPTS - 1:
                raise


def drop_unread(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete folders that none of the newest ``keep`` versions names; jobs that still read older ones must have ended."""
    oldest = Version(spark, path).number - keep
    last_named = _pointers(spark, path).where(F.col("day").isNotNull()).groupBy("folder", "day").agg(
        F.max("version").alias("version"))
    for row in last_named.where(F.col("version") <= oldest).toLocalIterator():
        delete_path(spark, f"{path}/{row.folder}/day={row.day}")
