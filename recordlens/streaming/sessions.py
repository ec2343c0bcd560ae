"""Streaming extension: sessions of activity and retention, on batches and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of events(user_id, ts): a new one after ``gap`` without any.

    On a stream pass ``late``, the time that an event may be late; state is dropped behind it.
    """
    source = events.withWatermark("ts", late) if late else events
    grouped = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


def region_stream(frames: DataFrame, gap: str, late: str, enter: float = 0.5) -> DataFrame:
    """Active stretches of a stream frames(file_id, ts, prob): frames at ``enter`` or above, merged over ``gap``."""
    active = frames.where(F.col("prob") >= enter).withColumnRenamed("file_id", "user_id")
    return sessions(active, gap, late).withColumnRenamed("user_id", "file_id")
