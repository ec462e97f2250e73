"""Windowed counts of events, for batch and stream alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """``window_start, event_type, n`` by tumbling hours; ``late`` sets a watermark, for streams."""
    counted = timed(events, late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def timed(events: DataFrame, late: str | None) -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return held.withWatermark("ts", late) if late else held


def sliding(events: DataFrame, late: str | None = None) -> DataFrame:
    """``window_start, event_type, n`` by hours that begin every half an hour."""
    counted = timed(events, late).groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, late: str | None = None, gap: str = "20 minutes") -> DataFrame:
    """``user_id, started, n``: runs of a user's events without a gap of that length."""
    counted = timed(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """``user_id, n, total`` after each batch of a stream: state kept for each user, for as long as the query runs."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder, as ``path, modificationTime, length, content``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def detected(files: DataFrame) -> DataFrame:
    """What each arriving file is. A file is a whole unit, so no state is kept between batches."""
    from palimpsest.operators.detect import detect

    return detect(files).select("path", "modificationTime", "variant", "size", "error")
