"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on. Shuffle width is left to the cluster; AQE coalesces it.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Parquet tables written here are replaced partition by partition, never as a whole.
PARTITION_OVERWRITE = {"partitionOverwriteMode": "dynamic"}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    On a local master without that setting a temporary folder, deleted when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_roots.get(id(spark.sparkContext))
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = _local_roots.setdefault(id(spark.sparkContext), tempfile.mkdtemp(prefix="netpen-stage-"))
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


_local_roots: dict[int, str] = {}
_open_jobs: list[list[str]] = []
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several outputs derive from one costly result: the lineage is cut, a lost executor
    re-reads files instead of recomputing, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_jobs:
        _open_jobs[-1].append(path)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _folders[staged] = path
    return staged


def release(staged: DataFrame) -> None:
    """Delete the folder of what ``stage`` returned, once nothing will read it any more."""
    path = _folders.pop(staged, None)
    if path:
        delete_path(staged.sparkSession, path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A job that has written its results when it ends: what it staged is deleted then."""
    _open_jobs.append([])
    try:
        yield
    finally:
        for path in _open_jobs.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
