"""Record types, enumerations and rank orders of the recording analysis."""

from __future__ import annotations

from pyspark.sql import types as T

# Domains and rank orders of the output fields.
TONES = ("neutral", "satisfied", "frustrated", "upset", "distressed")
INTENSITIES = ("low", "medium", "high")
SEVERITIES = ("none", "low", "medium", "high")
QUALITIES = ("clear", "slightly_impaired", "severely_impaired")
RANKS = {
    "emotional_tone": ("satisfied", "neutral", "frustrated", "upset", "distressed"),
    "emotional_intensity": INTENSITIES,
    "background_noise_severity": SEVERITIES,
    "audio_quality": QUALITIES,
}
FREE_TEXT = ("background_noise_type",)
DEFAULTS = {
    "emotional_tone": "neutral",
    "emotional_intensity": "low",
    "background_noise_present": False,
    "background_noise_type": "",
    "background_noise_severity": "none",
    "audio_quality": "clear",
    "speaker_overlap_present": False,
    "long_silence_present": False,
    "confidence": 0.5,
}
FIELDS = tuple(DEFAULTS)

ANALYSIS = T.StructType(
    [
        T.StructField(name, {str: T.StringType(), bool: T.BooleanType(), float: T.DoubleType()}[type(value)])
        for name, value in DEFAULTS.items()
    ]
)

#: Estimates whose absence lowers the confidence.
CORE = ("max_silence_s", "overlap_ratio", "noise_level_db", "degradation_score", "arousal", "valence")
LATENTS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("speech_ratio", "max_silence_s", "overlap_ratio")]
    + [T.StructField("n_speakers", T.IntegerType()), T.StructField("noise_level_db", T.DoubleType())]
    + [T.StructField("noise_class_dist", T.MapType(T.StringType(), T.DoubleType()))]
    + [T.StructField(n, T.DoubleType()) for n in ("degradation_score", "role_confidence", "customer_speech_s", "arousal", "valence")]
    + [T.StructField("valence_source", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("notes", "stubbed")]
)
RESULT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("result", ANALYSIS),
        T.StructField("error", T.StringType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("audio_s", T.DoubleType()),
        T.StructField("stage_times", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("latents", LATENTS),
    ]
)
