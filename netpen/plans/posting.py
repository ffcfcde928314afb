"""Posting of pending feeding records."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from netpen.functions.times import ntz


class Posting(NamedTuple):
    records: DataFrame
    posted_count: DataFrame


def post_pending(records: DataFrame, run_time: dt.datetime | str) -> Posting:
    """Post every pending record, whatever its day; posted rows stay as they are.

    Running it again on its own result changes nothing.
    """
    pending = F.col("posted") == 0
    records_after = records.withColumns({
        "posted_time": F.when(pending, ntz(run_time)).otherwise(F.col("posted_time")),
        "posted": F.when(pending, F.lit(1)).otherwise(F.col("posted")).cast("int"),
    })
    return Posting(records_after, records.agg(F.count_if(pending).alias("posted_count")))


def post_selected(records: DataFrame, wanted: DataFrame,
                  run_time: dt.datetime | str) -> tuple[DataFrame, DataFrame]:
    """Post the wanted record ids; returns the records after and the refused ids with a reason."""
    asked = wanted.select("record_id").distinct().withColumn("__asked", F.lit(True))
    marked = records.join(asked, "record_id", "left")
    due = F.col("__asked") & (F.col("posted") == 0)
    after = marked.withColumns({
        "posted_time": F.when(due, ntz(run_time)).otherwise(F.col("posted_time")),
        "posted": F.when(due, F.lit(1)).otherwise(F.col("posted")).cast("int"),
    }).drop("__asked")
    found = asked.join(records.select("record_id", "posted"), "record_id", "left")
    refused = found.select(
        "record_id",
        F.when(F.col("posted").isNull(), "record_missing")
        .when(F.col("posted") == 1, "already_posted").alias("reason")
    ).where(F.col("reason").isNotNull())
    return after, refused
