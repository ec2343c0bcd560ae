"""Arousal and valence of the customer: prosody averaged with a model's classes, words where they are needed, less of it where roles are unsure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.operators import emotion, samples
from recordlens.plans.prosody import RATE, prosody
from recordlens.sources.pcm import ROW_SAMPLES


def tone(speech: DataFrame, prosodic: DataFrame, classes: DataFrame | None = None, words: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """``(file_id, arousal, valence, valence_source)`` of speech(file_id, speech_s).

    ``prosodic`` is (file_id, arousal), ``classes`` (file_id, label, p) the posteriors of an emotion model, ``words``
    (file_id, lexical) the valence of transcripts, ``roles`` (file_id, role_confidence). Files without speech are
    neutral, from no source. Words are joined only where the sound is lively or unclear.
    """
    none = speech.limit(0)
    placed = emotion.project(classes) if classes is not None else none.select("file_id", F.lit(0.0).alias("valence"), F.lit(0.0).alias("arousal"))
    known = roles if roles is not None else none.select("file_id", F.lit(0.0).alias("role_confidence"))
    said = words if words is not None else none.select("file_id", F.lit(0.0).alias("lexical"))
    joined = (
        speech.where(F.coalesce("speech_s", F.lit(0.0)) > 0).select("file_id")
        .join(prosodic.select("file_id", F.col("arousal").alias("prosodic")), "file_id", "left")
        .join(placed.select("file_id", F.col("valence").alias("acoustic"), F.col("arousal").alias("classified")), "file_id", "left")
        .join(known.select("file_id", "role_confidence"), "file_id", "left")
        .select("file_id", emotion.mean_arousal(F.col("prosodic"), F.col("classified")).alias("arousal"), "acoustic", "role_confidence")
    )
    told = emotion.cascade(joined, said.select("file_id", "lexical"))
    quiet = speech.where(F.coalesce("speech_s", F.lit(0.0)) <= 0).select("file_id", F.lit(0.0).alias("arousal"), F.lit(0.0).alias("valence"), F.lit("none").alias("valence_source"))
    return told.select("file_id", F.round("arousal", 4).alias("arousal"), F.round("valence", 4).alias("valence"), "valence_source").unionByName(quiet)


def customer_tone(
    rows: DataFrame, speech: DataFrame, spans: DataFrame | None = None, classes: DataFrame | None = None, words: DataFrame | None = None, roles: DataFrame | None = None, row_samples: int = ROW_SAMPLES
) -> DataFrame:
    """``tone`` of recordings decoded at RATE, of the customer's spans(file_id, start_s, end_s) only; files without any are taken whole."""
    heard = rows if spans is None else samples.cut_to(rows, spans, RATE, row_samples)
    return tone(speech, prosody(heard).select("file_id", "arousal"), classes, words, roles)
