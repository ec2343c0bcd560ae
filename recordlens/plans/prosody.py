"""Prosody of recordings, from samples to arousal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators import emotion, windows
from recordlens.sources import audio

# Rate, frame and step; the shortest recording and the least numbers of frames and voiced frames that
# are judged; at most about so many voiced frames are asked for their pitch.
RATE, SIZE_S, HOP_S = 16_000, 0.025, 0.010
LEAST_S, LEAST_FRAMES, PITCHES = 0.5, 8, 120


def _modulations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rates = [audio.modulation(np.fromiter((e["rms"] for e in env), np.float64), 1 / HOP_S) if env is not None else 0.0 for env in batch["env"]]
        yield batch[["file_id"]].assign(rate=np.array(rates, np.float64))


def prosody(decoded: DataFrame) -> DataFrame:
    """(file_id, level_sd, pitch_sd, rate, tilt, arousal) of recordings decoded at RATE.

    Frames are measured in tasks; voiced ones, within 25 dB of the file's loud frames, give the spread
    of level, of pitch (evenly chosen frames) and the tilt. The rate of syllables needs the levels of a
    whole file in one row, 100 a second. A recording that is too short, or has hardly a voiced frame,
    has an arousal of 0 and nulls; one that can't be read has no row.
    """
    lengths = decoded.where(F.col("error").isNull()).groupBy(F.col("path").alias("file_id")).agg(F.sum(F.size("samples")).alias("samples"))
    frames = audio.voice_frames(decoded, SIZE_S, HOP_S).withColumn("db", 20.0 * F.log10(F.greatest("rms", F.lit(1e-10))))
    spoken = windows.voiced(frames, "db")
    level = spoken.groupBy("file_id").agg(
        F.count("*").alias("voiced"), F.stddev_pop("db").alias("level_sd"), F.log10((F.sum("high") + 1e-12) / (F.sum("low") + 1e-12)).alias("balance")
    )
    whole = Window.partitionBy("file_id")
    every = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / PITCHES))
    chosen = spoken.select("file_id", "f0", ((F.row_number().over(whole.orderBy("i")) - 1) % every).alias("k")).where("k = 0 and f0 is not null")
    pitch = windows.semitone_spread(chosen).select("file_id", F.col("semitone_sd").alias("pitch_sd"))
    envelopes = frames.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("i", "rms"))).alias("env"), F.count("*").alias("frames"))
    rates = envelopes.select("file_id", "env").mapInPandas(_modulations, "file_id string, rate double")
    joined = lengths.join(envelopes.select("file_id", "frames"), "file_id", "left").join(level, "file_id", "left").join(pitch, "file_id", "left").join(rates, "file_id", "left")
    judged = (F.col("samples") >= LEAST_S * RATE) & (F.col("frames") >= LEAST_FRAMES) & (F.col("voiced") >= LEAST_FRAMES)
    found = joined.select(
        "file_id",
        F.when(judged, F.col("level_sd")).alias("level_sd"),
        F.when(judged, F.coalesce("pitch_sd", F.lit(0.0))).alias("pitch_sd"),
        F.when(judged, F.coalesce("rate", F.lit(0.0))).alias("rate"),
        F.when(judged, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("balance") + 1.0))).alias("tilt"),
    )
    arousal = emotion.prosodic_arousal(*[F.col(c) for c in ("level_sd", "pitch_sd", "rate", "tilt")])
    return found.withColumn("arousal", F.when(F.col("level_sd").isNull(), 0.0).otherwise(arousal))
