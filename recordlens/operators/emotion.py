"""Arousal and valence from class posteriors, prosody and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.scalars import clamp, ramp

# Where the emotion classes lie, as (valence, arousal 0..1); other classes lie at (0, .2).
PLACES = {
    "neu": (0.00, 0.10), "neutral": (0.00, 0.10),
    "hap": (0.70, 0.55), "happy": (0.70, 0.55),
    "ang": (-0.70, 0.85), "angry": (-0.70, 0.85),
    "sad": (-0.55, 0.15), "sadness": (-0.55, 0.15),
}
OTHER_PLACE = (0.0, 0.2)
# Weights of the sources of valence; when words are worth transcribing; when a role is unsure.
ACOUSTIC, LEXICAL = 0.35, 0.65
CASCADE_AROUSAL, CASCADE_VALENCE, UNSURE_ROLE = 0.30, 0.35, 0.5


def project(posteriors: DataFrame) -> DataFrame:
    """Valence and arousal in -1..1 of posteriors(file_id, label, p)."""
    place = lambda k: F.coalesce(*[F.when(F.lower("label") == name, F.lit(v[k])) for name, v in PLACES.items()], F.lit(OTHER_PLACE[k]))
    sums = posteriors.groupBy("file_id").agg(F.sum(F.col("p") * place(0)).alias("v"), F.sum(F.col("p") * place(1)).alias("a"))
    return sums.select("file_id", clamp(F.col("v"), -1.0, 1.0).alias("valence"), clamp(2.0 * F.col("a") - 1.0, -1.0, 1.0).alias("arousal"))


def sentiment_valence(posteriors: DataFrame) -> DataFrame:
    """P(positive) - P(negative) of posteriors(file_id, label, p), in -1..1."""
    signed = F.when(F.lower("label").startswith("pos"), F.col("p")).when(F.lower("label").startswith("neg"), -F.col("p")).otherwise(0.0)
    return posteriors.groupBy("file_id").agg(clamp(F.sum(signed), -1.0, 1.0).alias("lexical"))


def prosodic_arousal(level_sd: Column, pitch_sd: Column, rate: Column, tilt: Column) -> Column:
    """Arousal in -1..1 from the spread of level and pitch, the rate of syllables and the tilt of the spectrum."""
    share = 0.30 * ramp(level_sd, 3.0, 11.0) + 0.30 * ramp(pitch_sd, 0.8, 4.0) + 0.20 * ramp(rate, 0.15, 0.55) + 0.20 * ramp(tilt, -0.6, 0.4)
    return clamp(share * 2.0 - 1.0, -1.0, 1.0)


def mean_arousal(prosodic: Column, classified: Column) -> Column:
    """The mean of the two, or the one there is."""
    return F.coalesce((prosodic + classified) / 2.0, prosodic, classified)


def needs_words(arousal: Column, valence: Column) -> Column:
    """Whether the acoustic estimate is lively or unclear enough to pay for a transcript."""
    return F.coalesce(arousal >= CASCADE_AROUSAL, F.lit(False)) | (F.abs(F.coalesce(valence, F.lit(0.0))) < CASCADE_VALENCE)


def fuse(acoustic: Column, lexical: Column) -> dict[str, Column]:
    """Valence and its source from what there is of the two."""
    both = acoustic.isNotNull() & lexical.isNotNull()
    return {
        "valence": F.when(both, ACOUSTIC * acoustic + LEXICAL * lexical).otherwise(F.coalesce(lexical, acoustic, F.lit(0.0))),
        "valence_source": F.when(both, "fused").when(lexical.isNotNull(), "lexical").when(acoustic.isNotNull(), "acoustic").otherwise("none"),
    }


def shrink(value: Column, role_confidence: Column) -> Column:
    """Closer to 0 where it is unsure who spoke; within -1..1."""
    factor = F.when(role_confidence < UNSURE_ROLE, 0.5 + role_confidence).otherwise(1.0)
    return clamp(value * factor, -1.0, 1.0)


def cascade(df: DataFrame, words: DataFrame) -> DataFrame:
    """``df(file_id, arousal, acoustic, role_confidence)`` with valence fused with words(file_id, lexical).

    Only rows that need words are joined to them: the expensive side sees no other row.
    """
    wanted = needs_words(F.col("arousal"), F.col("acoustic"))
    asked = df.where(wanted).join(words, "file_id", "left")
    rest = df.where(~wanted).withColumn("lexical", F.lit(None).cast("double"))
    fused = asked.unionByName(rest).withColumns(fuse(F.col("acoustic"), F.col("lexical")))
    return fused.withColumns({c: shrink(F.col(c), F.col("role_confidence")) for c in ("arousal", "valence")})
