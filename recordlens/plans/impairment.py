"""Quality of recordings, from samples to the degradation score, with the speech of a model outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.scalars import level_db
from recordlens.operators import quality, samples
from recordlens.operators.intervals import stab

#: Kinds of runs.
CLIPPED, QUIET = "clipped", "quiet"


def file_levels(measured: DataFrame) -> DataFrame:
    """``samples.measured_rows`` by file: peak, level of speech (of all where none is marked) and bands of it."""
    names = ("n", "square", "spoken_n", "spoken_square", "speech", "above", "frames", "spoken_speech", "spoken_above", "spoken_frames")
    sums = measured.groupBy("file_id", "rate", "length").agg(F.max("peak").alias("peak"), *[F.sum(c).alias(c) for c in names])
    spoken, framed = F.col("spoken_n") > 0, F.col("spoken_frames") > 0
    part = lambda name, of: F.try_divide(F.when(framed, F.col(f"spoken_{name}")).otherwise(F.col(name)), F.nullif(of, F.lit(0.0)))
    frames = F.when(framed, F.col("spoken_frames")).otherwise(F.col("frames"))
    return sums.select(
        "file_id", "rate", "length", "peak",
        F.sqrt(F.when(spoken, F.col("spoken_square") / F.col("spoken_n")).otherwise(F.col("square") / F.col("n"))).alias("rms"),
        F.coalesce(part("speech", frames), F.lit(0.0)).alias("speech"), F.coalesce(part("above", frames), F.lit(0.0)).alias("above"),
    )


def impaired_runs(rows: DataFrame, levels: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Runs of rows(path, first, samples, ...) near each file's peak, and, in files with speech, far below its level."""
    speaking = None if regions is None else regions.where("end_s > start_s").select("file_id").distinct().withColumn("speaks", F.lit(True))
    known = levels.select("file_id", "peak", "rms").withColumn("speaks", F.lit(False)) if speaking is None else levels.select("file_id", "peak", "rms").join(speaking, "file_id", "left")
    clip = F.when(F.col("peak") > 0, quality.CLIP_LEVEL * F.col("peak"))
    quiet = F.when(F.coalesce("speaks", F.lit(False)), quality.hole_floor(F.col("rms")))
    limits = known.select(F.col("file_id").alias("path"), clip.alias("clip"), quiet.alias("quiet"))
    held = rows.where(F.col("error").isNull()).select("path", "first", "samples").join(limits, "path")
    return samples.sample_runs(held, {CLIPPED: (F.col("clip"), True, quality.CLIP_RUN), QUIET: (F.col("quiet"), False, 1)})


def holes(runs: DataFrame, levels: DataFrame, regions: DataFrame) -> DataFrame:
    """The quiet runs of HOLE_S whose middle lies in a region."""
    quiet = runs.where(F.col("kind") == QUIET).join(levels.select("file_id", "rate"), "file_id")
    least, most = (F.greatest(F.lit(1), F.floor(F.lit(s) * F.col("rate"))) for s in quality.HOLE_S)
    return stab(quiet.where(F.col("n").between(least, most)).withColumn("mid_s", (F.col("first_i") + F.col("last_i") + 1) / 2 / F.col("rate")), "mid_s", regions)


def impairments(measured: DataFrame, rows: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``(file_id, clipping, dropouts, level, bandwidth, degradation_score)`` of decoded recordings.

    ``measured`` are ``samples.measured_rows`` of ``rows``, made with the same regions(file_id, start_s, end_s). Speech
    decides where level and bandwidth are measured, and what counts as a hole; without regions a
    file has no holes and all of it counts. Files that can't be read have no row.
    """
    levels = file_levels(measured)
    runs = impaired_runs(rows, levels, regions)
    railed = runs.where(F.col("kind") == CLIPPED).join(levels.select("file_id", "peak"), "file_id")
    flat = railed.where(F.col("high") - F.col("low") <= quality.CLIP_SPREAD * F.col("peak"))
    clipped = flat.groupBy("file_id").agg(F.sum("n").alias("clipped"), F.max("n").alias("longest"))
    joined = levels.join(clipped, "file_id", "left")
    if regions is None:
        joined = joined.withColumn("per_second", F.lit(0.0))
    else:
        counted = holes(runs, levels, regions).groupBy("file_id").agg(F.count("*").alias("holes"))
        spoken = regions.groupBy("file_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s")).join(counted, "file_id", "left")
        rate = spoken.select("file_id", F.try_divide(F.coalesce("holes", F.lit(0)), F.when(F.col("speech_s") != 0, F.col("speech_s")).otherwise(1.0)).alias("per_second"))
        joined = joined.join(rate, "file_id", "left")
    drop = 10.0 * F.log10((F.col("above") + 1e-20) / (F.col("speech") + 1e-20))
    top = F.when(F.col("speech") > 0, F.least(F.lit(samples.TOP_HZ), F.col("rate") / 2 * samples.USABLE)).otherwise(0.0)
    scores = joined.select(
        "file_id",
        quality.clipping_score(F.coalesce(F.col("clipped") / F.col("length"), F.lit(0.0)), F.coalesce("longest", F.lit(0)).cast("double")).alias("clipping"),
        quality.dropout_score(F.coalesce("per_second", F.lit(0.0))).alias("dropouts"),
        quality.level_score(level_db(F.col("rms"))).alias("level"),
        quality.bandwidth_score(F.col("rate").cast("double"), drop, top).alias("bandwidth"),
    )
    return quality.degradation(scores).withColumn("degradation_score", F.round("degradation_score", 4))
