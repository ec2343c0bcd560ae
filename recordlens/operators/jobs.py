"""Batches of recordings: listings, totals, stage times and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.scalars import real_time_factor

# Batches that are kept, audio seconds after which a batch's files go.
KEPT_JOBS, RETENTION_S = 40, 3600.0


def stage_totals(results: DataFrame) -> DataFrame:
    """Seconds of each stage over results(stage_times map, audio_s), and their real-time factor, the longest first."""
    audio = results.agg(F.sum("audio_s")).scalar()  # a subquery of one number
    times = results.select(F.explode("stage_times").alias("stage", "seconds")).groupBy("stage").agg(F.sum("seconds").alias("total_s"))
    timed = times.withColumn("_audio", audio).select("stage", "total_s", real_time_factor(F.col("total_s"), F.col("_audio")).alias("rtf"))
    return timed.orderBy(F.col("total_s").desc(), "stage")


def batch_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Counts, audio minutes, seconds of work and real-time factor of results(status, elapsed_s, audio_s)."""
    sums = results.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count("*").alias("n"),
        (F.sum("audio_s") / 60.0).alias("audio_min"),
        F.sum("elapsed_s").alias("elapsed_s"),
    )
    return sums.withColumn("rtf", real_time_factor(F.col("elapsed_s"), F.col("audio_min") * 60.0))


def newest(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest of jobs(job_id, started): a top-k, no full sort."""
    return jobs.orderBy(F.col("started").desc(), F.col("job_id").desc()).limit(n)


def evicted(jobs: DataFrame, *keys: str, keep: int = KEPT_JOBS) -> DataFrame:
    """Jobs beyond the ``keep`` newest of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col("started").desc(), F.col("job_id").desc())
    return jobs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > keep).drop("_n")


def expired(finished: Column, now: Column, retention_s: float = RETENTION_S) -> Column:
    return F.coalesce(now - finished > retention_s, F.lit(False))


def upload_totals(members: DataFrame) -> DataFrame:
    """Members, bytes and largest compression ratio of each archive of members(archive, size, packed)."""
    ratio = F.max(F.when(F.col("packed") > 0, F.col("size") / F.col("packed")))
    return members.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.coalesce(ratio, F.lit(0.0)).alias("max_ratio"))
