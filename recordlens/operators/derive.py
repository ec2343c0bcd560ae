"""From estimates to the nine output fields."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.config import TUNED, Thresholds
from recordlens.functions.scalars import binned, margin
from recordlens.schema import CORE, INTENSITIES, QUALITIES, SEVERITIES

# What stands in for an estimate that nothing has made.
STUBS = {
    "speech_ratio": 1.0, "max_silence_s": 0.0, "overlap_ratio": 0.0, "noise_level_db": -60.0,
    "degradation_score": 0.0, "arousal": 0.0, "valence": 0.0,
}
# Distances at which a decision counts as certain.
SCALES = {"noise": 6.0, "quality": 0.15, "silence": 4.0, "overlap": 0.03, "valence": 0.3, "arousal": 0.2}


def missing(df: DataFrame) -> Column:
    """Names of the core estimates that are null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CORE]))


def unevidenced(df: DataFrame) -> Column:
    """Names of the core estimates that are null or stand-ins."""
    return F.array_compact(F.array(*[F.when(_absent(df, c), F.lit(c)) for c in CORE]))


def unevidenced_count(df: DataFrame) -> Column:
    """How many names ``unevidenced`` has, without the array."""
    return reduce(add, [_absent(df, c).cast("int") for c in CORE])


def _absent(df: DataFrame, name: str) -> Column:
    if "stubbed" not in df.columns:
        return F.col(name).isNull()
    return F.col(name).isNull() | F.coalesce(F.array_contains("stubbed", name), F.lit(False))


def fill_stubs(df: DataFrame) -> DataFrame:
    """Stand-ins for null estimates; ``stubbed`` names them, after those it named before."""
    names = [c for c in STUBS if c in df.columns]
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))
    before = F.coalesce("stubbed", F.array().cast("array<string>")) if "stubbed" in df.columns else F.array().cast("array<string>")
    return df.withColumns({"stubbed": F.array_union(before, filled)} | {c: F.coalesce(F.col(c), F.lit(STUBS[c])) for c in names})


def best_class(scores: Column) -> Column:
    """The entry of the highest score in a map, of equal ones the first in alphabetical order."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("term"), e["value"].alias("score")))
    return F.try_element_at(F.array_sort(entries), F.lit(1))


def repaired(tone: Column, intensity: Column, present: Column, kind: Column, severity: Column) -> dict[str, Column]:
    """The fields after the consistency rules; null fields take their defaults first."""
    present = F.coalesce(present, F.lit(False))
    tone, intensity = F.coalesce(tone, F.lit("neutral")), F.coalesce(intensity, F.lit("low"))
    severity, kind = F.coalesce(severity, F.lit("none")), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    calm = (tone == "neutral") & (intensity == "high")
    faint = (tone == "distressed") & (intensity == "low")
    return {
        "emotional_tone": tone,
        "emotional_intensity": F.when(calm | faint, "medium").otherwise(intensity),
        "background_noise_present": present,
        "background_noise_type": F.when(~present, "").when(kind == "", "unspecified").otherwise(kind),
        "background_noise_severity": F.when(~present, "none").when(severity == "none", "low").otherwise(severity),
    }


def derive(df: DataFrame, t: Thresholds = TUNED) -> DataFrame:
    """``df`` with the nine output fields from its estimates; pure column expressions, no shuffle.

    An estimate that is null leaves its fields at their defaults and adds no margin. Confidence
    falls with missing or stand-in estimates, with values near a threshold and with unsure roles.
    """
    level, d, s, o = (F.col(c) for c in ("noise_level_db", "degradation_score", "max_silence_s", "overlap_ratio"))
    a, v, role = F.col("arousal"), F.col("valence"), F.col("role_confidence")
    scores = F.col("noise_class_dist") if "noise_class_dist" in df.columns else F.lit(None).cast("map<string,double>")
    best = F.col("_best")  # a column of its own, so that the map is sorted once
    present = level >= t.noise_present_db
    empty = F.coalesce(F.size(scores), F.lit(0)) <= 0
    moved = a.isNotNull() & v.isNotNull()
    tone = F.when(
        moved,
        F.when((a >= t.distress_arousal) & (v <= t.distress_valence), "distressed")
        .when((F.abs(v) < t.valence_neutral_band) & (a < t.arousal_high), "neutral")
        .when(v > 0, "satisfied")
        .when((v <= t.valence_upset) | (a >= t.arousal_high), "upset")
        .otherwise("frustrated"),
    )
    margins = {
        "_type": F.when(present & ~empty & (best["score"] < t.noise_type_min_score), 0.0),
        "_noise": F.when(level.isNotNull(), margin(level, [t.noise_present_db], SCALES["noise"])),
        "_quality": F.when(d.isNotNull(), margin(d, [t.quality_slight, t.quality_severe], SCALES["quality"])),
        "_silence": F.when(s.isNotNull(), margin(s, [t.long_silence_s], SCALES["silence"])),
        "_overlap": F.when(o.isNotNull(), margin(o, [t.overlap_ratio_min], SCALES["overlap"])),
        "_valence": F.when(moved, margin(v, [0.0, t.valence_upset], SCALES["valence"])),
        "_arousal": F.when(moved, margin(a, [t.arousal_low, t.arousal_high], SCALES["arousal"])),
    }
    # margins are columns of their own, so that the generated code holds each once and stays small
    known = t.conf_base - t.conf_missing_penalty * unevidenced_count(df)
    counted = {
        "_known": known,
        "_role": F.when(role.isNotNull(), 1.0 - t.conf_role_weight * (1.0 - role)).otherwise(1.0),
        "_sum": reduce(add, [F.coalesce(m, F.lit(0.0)) for m in margins]),
        "_n": reduce(add, [F.col(m).isNotNull().cast("int") for m in margins]),
    }
    sure = F.col("_known") * F.when(F.col("_n") > 0, 0.65 + 0.35 * (F.col("_sum") / F.greatest("_n", F.lit(1)))).otherwise(1.0) * F.col("_role")
    fields = repaired(
        tone,
        F.when(moved, binned(a, [t.arousal_low, t.arousal_high], INTENSITIES)),
        present,
        F.when(present, F.when(empty, "static").otherwise(best["term"])),
        F.when(present, binned(level, [t.noise_medium_db, t.noise_high_db], SEVERITIES[1:])),
    ) | {
        "audio_quality": F.coalesce(binned(d, [t.quality_slight, t.quality_severe], QUALITIES), F.lit("clear")),
        "speaker_overlap_present": F.coalesce(o >= t.overlap_ratio_min, F.lit(False)),
        "long_silence_present": F.coalesce(s >= t.long_silence_s, F.lit(False)),
        "confidence_exact": F.greatest(F.lit(t.conf_floor), F.least(F.lit(1.0), sure)),
    }
    done = df.withColumn("_best", best_class(scores)).withColumns(margins).withColumns(counted).withColumns(fields)
    return done.drop("_best", *margins, *counted).withColumn("confidence", F.round("confidence_exact", 3))
