"""Regions, gaps, runs and joins against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from recordlens.operators import intervals, windows


def loop_regions(probs, hop):
    """The regions of one file by a state machine."""
    on, start, raw = False, 0.0, []
    for k, p in enumerate(probs):
        if not on and p >= 0.5:
            on, start = True, k * hop
        elif on and p < 0.35:
            on = False
            raw.append([start, (k + 1) * hop])
    duration = len(probs) * hop
    if on:
        raw.append([start, duration])
    padded = [[max(0.0, a - 0.06), min(duration, b + 0.06)] for a, b in raw]
    merged = []
    for a, b in padded:
        if merged and a - merged[-1][1] < 0.2:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(round(a, 6), round(b, 6)) for a, b in merged if b - a >= 0.12]


def test_regions_and_gaps(spark):
    draw = random.Random(3)
    files = {k: [draw.random() for _ in range(draw.randrange(1, 120))] for k in range(12)} | {90: [0.0] * 20, 91: [1.0] * 20}
    rows = [(k, i, p) for k, probs in files.items() for i, p in enumerate(probs)]
    for hop in (0.032, 0.5):
        frames = spark.createDataFrame(rows, "file_id long, i long, prob double")
        regions = intervals.speech_regions(frames, hop)
        found = {}
        for r in regions.collect():
            found.setdefault(r["file_id"], []).append((round(r["start_s"], 6), round(r["end_s"], 6)))
        durations = spark.createDataFrame([(k, len(p) * hop) for k, p in files.items()], "file_id long, duration_s double")
        holes = {}
        for r in intervals.gaps(regions, durations).collect():
            holes.setdefault(r["file_id"], []).append((r["start_s"], r["end_s"]))
        summary = {r["file_id"]: r for r in intervals.speech_summary(regions, durations).collect()}
        for k, probs in files.items():
            want = loop_regions(probs, hop)
            assert sorted(found.get(k, [])) == want
            spoken = sum(b - a for a, b in want)
            silent = sum(b - a for a, b in holes.get(k, []))
            assert abs(spoken + silent - len(probs) * hop) < 1e-4
            assert abs(summary[k]["speech_s"] - spoken) < 1e-4
    assert summary[90]["speech_ratio"] == 0.0 and abs(summary[90]["max_silence_s"] - 10.0) < 1e-9


def test_runs_stab_and_text(spark):
    flags = spark.createDataFrame([(1, i, i in (0, 1, 4, 7, 8, 9)) for i in range(10)], "file_id long, i long, f boolean")
    runs = intervals.true_runs(flags, F.col("f")).collect()
    assert sorted((r["first_i"], r["last_i"], r["n"]) for r in runs) == [(0, 1, 2), (4, 4, 1), (7, 9, 3)]
    points = spark.createDataFrame([(1, 5.0), (1, 200.0), (2, 5.0), (1, 130.0)], "file_id long, at_s double")
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 100.0, 150.0), (1, 110.0, 140.0)], "file_id long, start_s double, end_s double")
    assert sorted(intervals.stab(points, "at_s", spans).collect()) == [(1, 5.0), (1, 130.0)]
    said = spark.createDataFrame([(1, 0.0, 2.0, "a"), (1, 3.0, 4.0, "b"), (2, 0.0, 1.0, "c")], "file_id long, start_s double, end_s double, text string")
    only = spark.createDataFrame([(1, 3.0, 5.0)], "file_id long, start_s double, end_s double")
    assert {r["file_id"]: r["text"] for r in intervals.text_in_regions(said, only).collect()} == {1: "b", 2: "c"}


def test_overlap(spark):
    spans = spark.createDataFrame([(1, 0.0, 4.0), (1, 3.0, 6.0), (1, 3.5, 3.75), (2, 0.0, 1.0)], "file_id long, start_s double, end_s double")
    found = {r["file_id"]: (r["support_s"], r["overlap_s"]) for r in intervals.overlap_ratio(spans).collect()}
    assert found == {1: (6.0, 1.0), 2: (1.0, 0.0)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=1, max_size=40), st.integers(1, 7))
def test_sliding_minimum(spark, values, width):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "file_id long, i long, v double")
    found = {r["i"]: r["low"] for r in windows.sliding_minimum(rows, "v", width).collect()}
    assert found == {i: min(values[i : i + width]) for i in range(len(values) - width + 1)}


def test_even_sample(spark):
    for n, cap in ((5, 6), (6, 6), (7, 6), (100, 6), (241, 24)):
        rows = spark.range(n).select(F.lit(1).alias("file_id"), F.col("id").alias("i"))
        want = list(range(n)) if n <= cap else sorted({int(k * (n - 1) / (cap - 1)) for k in range(cap)})
        assert sorted(r["i"] for r in windows.even_sample(rows, cap).collect()) == want
