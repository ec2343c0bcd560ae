"""The nine fields: anchors, edges and invariants."""

import random

import pytest
from pyspark.sql import functions as F
from recordlens.config import TUNED
from recordlens.operators.derive import STUBS, derive, fill_stubs, missing, repaired, unevidenced
from recordlens.schema import CORE, DEFAULTS, INTENSITIES, QUALITIES, SEVERITIES, TONES

SCHEMA = (
    "noise_level_db double, noise_class_dist map<string,double>, degradation_score double, max_silence_s double, "
    "overlap_ratio double, arousal double, valence double, role_confidence double, stubbed array<string>"
)
# estimates, then tone, intensity, present, type, severity, quality, overlap, silence, confidence
GOLDEN = [
    ((None, {}, None, None, None, None, None, None, None), ("neutral", "low", False, "", "none", "clear", False, False, 0.31)),
    ((-60.0, {}, 0.0, 0.0, 0.0, 0.0, 0.0, None, None), ("neutral", "low", False, "", "none", "clear", False, False, 0.784)),
    ((-60.0, {}, 0.0, 0.0, 0.0, 0.0, 0.0, None, list(CORE)), ("neutral", "low", False, "", "none", "clear", False, False, 0.286)),
    ((-53.0, {"music": 0.5, "alarm": 0.5}, 0.25, 12.0, 0.02, 0.2, 0.2, None, None), ("satisfied", "medium", True, "alarm", "low", "slightly_impaired", True, True, 0.586)),
    ((-52.99, {}, 0.55, 11.99, 0.0199, 0.55, 0.0, None, None), ("upset", "high", True, "static", "low", "severely_impaired", False, False, 0.553)),
    ((-50.0, {"static": 0.1}, 0.2499, 0.0, 0.0, 0.8, -0.6, 1.0, None), ("distressed", "high", True, "static", "medium", "clear", False, False, 0.708)),
    ((-24.0, {"hum": 0.9}, 1.0, 30.0, 0.5, 0.3, -0.3, 0.0, None), ("frustrated", "medium", True, "hum", "high", "severely_impaired", True, True, 0.64)),
    ((-90.0, {}, 0.0, 3.0, 0.0, 0.5, -0.45, None, None), ("upset", "medium", False, "", "none", "clear", False, False, 0.747)),
    ((-90.0, {}, 0.0, 3.0, 0.0, 0.6, 0.05, None, None), ("satisfied", "high", False, "", "none", "clear", False, False, 0.755)),
    ((None, {}, None, None, None, 0.9, -0.9, None, None), ("distressed", "high", False, "", "none", "clear", False, False, 0.49)),
]


def test_golden(spark):
    df = spark.createDataFrame([(k, *x) for k, (x, _) in enumerate(GOLDEN)], "k int, " + SCHEMA)
    rows = {r["k"]: r for r in derive(df).select("k", *DEFAULTS).collect()}
    for k, (_, want) in enumerate(GOLDEN):
        assert tuple(rows[k][name] for name in DEFAULTS) == want


def test_invariants(spark):
    draw = random.Random(0)
    some = lambda low, high: None if draw.random() < 0.15 else draw.uniform(low, high)
    terms = ["television", "static", "music", "office chatter", "road noise"]
    rows = [
        (some(-90, 0), {} if draw.random() < 0.2 else {draw.choice(terms): draw.random()}, some(0, 1), some(0, 120), some(0, 1), some(-1, 1), some(-1, 1), some(0, 1), None)
        for _ in range(4000)
    ]
    out = derive(spark.createDataFrame(rows, SCHEMA))
    quiet = ~F.col("background_noise_present")
    wrong = out.where(
        ~F.col("emotional_tone").isin(*TONES) | ~F.col("emotional_intensity").isin(*INTENSITIES) | ~F.col("background_noise_severity").isin(*SEVERITIES)
        | ~F.col("audio_quality").isin(*QUALITIES) | ~F.col("confidence").between(TUNED.conf_floor, 1.0)
        | (quiet & ((F.col("background_noise_type") != "") | (F.col("background_noise_severity") != "none")))
        | (~quiet & ((F.col("background_noise_type") == "") | (F.col("background_noise_severity") == "none")))
    )
    assert wrong.count() == 0
    assert out.agg(F.count_distinct("emotional_tone")).first()[0] == len(TONES)


def test_stubs_and_missing(spark):
    row = (None, {}, 0.5, None, 0.1, None, 0.2, None, ["valence"])
    df = spark.createDataFrame([row], SCHEMA)
    filled = fill_stubs(df).first()
    assert filled["stubbed"] == ["valence", "max_silence_s", "noise_level_db", "arousal"]
    assert filled["noise_level_db"] == STUBS["noise_level_db"] and filled["degradation_score"] == 0.5
    found = df.select(missing(df).alias("m"), unevidenced(df).alias("u")).first()
    assert found["m"] == ["max_silence_s", "noise_level_db", "arousal"]
    assert found["u"] == ["max_silence_s", "noise_level_db", "arousal", "valence"]


@pytest.mark.parametrize(
    "given, want",
    [
        (("neutral", "high", True, " TV ", "none"), ("neutral", "medium", True, "tv", "low")),
        (("distressed", "low", False, "music", "high"), ("distressed", "medium", False, "", "none")),
        ((None, None, None, None, None), ("neutral", "low", False, "", "none")),
        (("upset", "high", True, "", "medium"), ("upset", "high", True, "unspecified", "medium")),
    ],
)
def test_repair(spark, given, want):
    df = spark.createDataFrame([given], "tone string, intensity string, present boolean, kind string, severity string")
    fields = repaired(*(F.col(c) for c in df.columns))
    assert tuple(df.select(*[c.alias(n) for n, c in fields.items()]).first()) == want
