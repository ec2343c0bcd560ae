"""Noise of recordings at their own rate, from measured rows to its level and the terms that its spectrum suggests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.scalars import clamp
from recordlens.operators import classdist, windows
from recordlens.operators.samples import USABLE
from recordlens.sources.audio import NFFT

# What a floor lacks as a minimum; percentiles of noise and speech; level where nothing can be measured.
BIAS, NOISE_SHARE, SPEECH_SHARE, SILENT_DB = 1.5, 0.9, 0.5, -90.0
# The band that is judged, the edges of its low and high parts, and its bins at least; mains
# frequencies, their harmonics and the width about them in Hz; terms kept.
BAND, LOW_HZ, HIGH_HZ, LEAST_BINS = (150.0, 3400.0), 400.0, 1500.0, 8
MAINS, HARMONICS, ABOUT_HZ = (50.0, 60.0), (1, 2, 3), 6.0
TERMS = 8


def noise_level(measured: DataFrame) -> DataFrame:
    """``(file_id, noise_level_db)`` of ``samples.measured_rows``: the floor's 90th percentile against the median power of speech.

    Where no frame is marked as speech, all are. Recordings of fewer than four spectra or eight
    frames are silent.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("values")) for kind in ("floor", "power", "spoken")])
    long = measured.select("file_id", F.explode(kinds).alias("x")).select("file_id", "x.kind", F.explode("x.values").alias("value"))
    share = lambda kind, at: F.percentile(F.when(F.col("kind") == kind, F.col("value")), at)
    found = long.groupBy("file_id").agg(
        share("floor", NOISE_SHARE).alias("noise"), F.coalesce(share("spoken", SPEECH_SHARE), share("power", SPEECH_SHARE)).alias("speech")
    )
    db = lambda x: 10.0 * F.log10(x + 1e-30)
    level = clamp(db(BIAS * F.col("noise")) - db(F.col("speech")), SILENT_DB, 0.0)
    return measured.select("file_id").distinct().join(found, "file_id", "left").select("file_id", F.coalesce(level, F.lit(SILENT_DB)).alias("noise_level_db"))


def floor_spectrum(measured: DataFrame) -> DataFrame:
    """``(file_id, rate, hz, power)``: by frequency the median of the minima; none of recordings that are hardly longer than a window.

    Equal minima come as one value with a count, so a median is one of values and counts.
    """
    runs = measured.select("file_id", "rate", F.explode(F.arrays_zip("band", "low", "times")).alias("x")).select("file_id", "rate", "x.*")
    floors = runs.groupBy("file_id", "rate", "band").agg(F.percentile("low", 0.5, F.col("times")).alias("power"))
    return floors.select("file_id", "rate", (F.col("band") * F.col("rate") / NFFT).alias("hz"), "power")


def floor_shape(floors: DataFrame) -> DataFrame:
    """flatness, low_share, high_share and hum_share of floor spectra; none of a silent floor or one of fewer than LEAST_BINS."""
    inside = (F.col("hz") >= BAND[0]) & (F.col("hz") <= F.least(F.lit(BAND[1]), F.col("rate") / 2 * USABLE))
    of = lambda which: F.sum(F.when(which, F.col("power")).otherwise(0.0))
    each = lambda f: reduce(lambda a, b: a + b, [of(F.abs(F.col("hz") - k * f) <= ABOUT_HZ) for k in HARMONICS])
    hum = floors.groupBy("file_id").agg(of(inside).alias("all"), F.count_if(inside).alias("bins"), F.greatest(*[each(f) for f in MAINS]).alias("hum"))
    usable = hum.where((F.col("all") > 0) & (F.col("bins") >= LEAST_BINS))
    share = floors.where(inside).withColumn("power", F.try_divide("power", F.sum("power").over(Window.partitionBy("file_id"))))
    shape = windows.spectral_shape(share.where("power is not null"), LOW_HZ, HIGH_HZ)
    return shape.join(usable.select("file_id", (F.col("hum") / F.greatest(F.col("all"), F.lit(1e-30))).alias("hum_share")), "file_id")


def noise_terms(measured: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(file_id, noise_class_dist) of measured recordings.

    The terms of the floor's shape are added at half weight to votes(file_id, term, score) of a model
    outside, or taken whole where a file has none; shares of the sum, the TERMS largest are kept.
    Recordings without a term have no row.
    """
    found = classdist.spectral_signature(floor_shape(floor_spectrum(measured)))
    given = found.limit(0) if votes is None else votes
    all_terms = classdist.shares(classdist.add_signature(given, found))
    rounded = all_terms.withColumn("share", F.round("share", 4))
    return classdist.as_map(classdist.ranked(rounded, "share", TERMS))


def noise(measured: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(file_id, noise_level_db, noise_class_dist) of measured recordings."""
    return noise_level(measured).withColumn("noise_level_db", F.round("noise_level_db", 2)).join(noise_terms(measured, votes), "file_id", "left")
