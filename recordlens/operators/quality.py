"""Impairments of a recording and their sum, the degradation score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.scalars import level_db, noisy_or, ramp
from recordlens.operators.intervals import stab, true_runs

# Seconds a hole may last, its level below the file's, and runs of clipped samples.
HOLE_S, HOLE_DB, CLIP_RUN, CLIP_SPREAD = (0.004, 0.250), -55.0, 3, 0.002
CLIP_LEVEL = 0.985


def clipping_score(share: Column, longest: Column) -> Column:
    return F.greatest(ramp(share, 0.0005, 0.04), ramp(longest, 8.0, 100.0))


def dropout_score(per_second: Column) -> Column:
    return ramp(per_second, 0.3, 5.0)


def level_score(db: Column) -> Column:
    """Too quiet or too loud."""
    return F.greatest(ramp(-db, 42.0, 60.0), ramp(db, -6.0, -1.5))


def bandwidth_score(rate: Column, drop_db: Column, top_hz: Column) -> Column:
    """A low sampling rate, or a spectrum that ends early in a file that could hold more."""
    return F.greatest(ramp(-rate, -16000.0, -7900.0) * 0.55, F.when(top_hz > 4200, ramp(-drop_db, 32.0, 48.0)).otherwise(0.0))


def hole_floor(rms: Column, hole_db: float = HOLE_DB) -> Column:
    """The magnitude below which there is a hole in speech of this level."""
    return F.greatest(F.lit(1e-6), rms * 10 ** (hole_db / 20))


def dropouts(frames: DataFrame, regions: DataFrame, hop: float, hole_s: tuple[float, float] = HOLE_S, hole_db: float = HOLE_DB) -> DataFrame:
    """Holes of frames(file_id, i, rms): short runs far below the level of speech whose middle is in speech.

    The level is that of the frames whose middle lies in a region, or of all where none does.
    """
    square = F.col("rms") * F.col("rms")
    spoken = stab(frames.withColumn("mid_s", (F.col("i") + 0.5) * hop), "mid_s", regions).groupBy("file_id").agg(F.avg(square).alias("speech"))
    levels = frames.groupBy("file_id").agg(F.avg(square).alias("whole")).join(spoken, "file_id", "left")
    floors = levels.select("file_id", hole_floor(F.sqrt(F.coalesce("speech", "whole")), hole_db).alias("floor"))
    runs = true_runs(frames.join(floors, "file_id"), F.col("rms") < F.col("floor"))
    timed = runs.withColumn("length_s", F.col("n") * hop).where(F.col("length_s").between(*hole_s))
    return stab(timed.withColumn("mid_s", (F.col("first_i") + F.col("last_i") + 1) * hop / 2), "mid_s", regions)


def degradation(scores: DataFrame) -> DataFrame:
    """``degradation_score`` of scores(clipping, dropouts, level, bandwidth)."""
    return scores.withColumn("degradation_score", noisy_or({n: F.col(n) for n in ("clipping", "dropouts", "level", "bandwidth")}))


def file_level(samples: DataFrame) -> DataFrame:
    """Root mean square and level of samples(file_id, x)."""
    rms = samples.groupBy("file_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return rms.withColumn("level_db", level_db(F.col("rms")))
