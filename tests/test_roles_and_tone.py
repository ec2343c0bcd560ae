"""Speaker clusters, role cascade and tone from samples, against plain versions over whole files."""

import re

import numpy as np
import pytest
from recordlens.operators import clusters, samples
from recordlens.operators.roles import AGENT_PATTERNS, CUSTOMER_PATTERNS
from recordlens.plans import roles, tone
from recordlens.plans.prosody import prosody
from recordlens.sources import audio
from test_samples import wav

RATE, ROW = 16_000, 1 << 14


def plain_split(x, starts=10, rounds=50):
    best, best_sum = np.zeros(len(x), int), -np.inf
    for first in np.unique(np.linspace(0, len(x) - 1, min(starts, len(x))).astype(int)):
        middle = x[[first, int(np.argmin(x @ x[first]))]].copy()
        label = np.full(len(x), -1)
        for _ in range(rounds):
            near = x @ middle.T
            new = (near[:, 1] > near[:, 0]).astype(int)
            if (new == label).all():
                break
            label = new
            for k in (0, 1):
                if (label == k).any():
                    mean = x[label == k].mean(axis=0)
                    middle[k] = mean / (np.linalg.norm(mean) or 1.0)
        total = (x * middle[label]).sum()
        if total > best_sum + 1e-9:
            best, best_sum = label, total
    return np.abs(best - best[0])


def test_two_means_of_all_files_at_once(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for file, (n, spread) in enumerate([(30, 0.2), (60, 0.5), (25, 1.0), (80, 0.8), (1, 1.0), (2, 1.0), (5, 0.3)]):
        base = rng.standard_normal((2, 12))
        x = base[rng.integers(0, 2, n)] + spread * rng.standard_normal((n, 12))
        ids = np.sort(rng.choice(1000, n, replace=False)).tolist()
        rows += [(f"f{file}", i, v.tolist()) for i, v in zip(ids, x)]
        want |= {(f"f{file}", i): int(c) for i, c in zip(ids, plain_split(x / np.linalg.norm(x, axis=1, keepdims=True)))}
    frame = spark.createDataFrame(rows, "file_id string, id long, embedding array<double>").repartition(5)
    assert {(r["file_id"], r["id"]): r["cluster"] for r in clusters.two_means(frame).collect()} == want
    plan = clusters.two_means(frame, rounds=1)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_speakers_rules(spark):
    rng = np.random.default_rng(4)
    rows = [("close", k, (np.array([1.0, 0.1 * (k % 2)]) + 0.001 * rng.standard_normal(2)).tolist()) for k in range(20)]
    rows += [("apart", k, [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(300)] + [("few", k, [1.0, 0.0] if k else [0.0, 1.0]) for k in range(3)]
    frame = spark.createDataFrame(rows, "file_id string, id long, embedding array<double>")
    found, free = clusters.speakers(frame).toPandas(), clusters.speakers(frame, separate=False).toPandas()
    both = {f: g["cluster"].nunique() for f, g in found.groupby("file_id")}
    assert both == {"close": 1, "apart": 2, "few": 1} and free[free["file_id"] == "close"]["cluster"].nunique() == 2
    assert (found["file_id"] == "apart").sum() == 240  # a file's windows are bounded, evenly spaced


def calls():
    """Two calls of two voices, the second without words, and one of a single voice."""
    rng = np.random.default_rng(8)
    out = {}
    for name, seconds in (("words", 12.0), ("sound", 12.0), ("single", 6.0)):
        x = np.zeros(int(seconds * RATE))
        turns = [(0.5 + 1.9 * k, 0.5 + 1.9 * k + 1.6, k % 2 if name != "single" else 0) for k in range(int(seconds // 2))]
        for a, b, voice in turns:
            n = int(b * RATE) - int(a * RATE)
            t = np.arange(n) / RATE
            beat = (np.sin(2 * np.pi * 3 * t) > 0) * (1 + 0.5 * voice * np.sin(2 * np.pi * 0.5 * t + a))
            x[int(a * RATE) : int(b * RATE)] = 0.2 * np.sin(2 * np.pi * (140 + 60 * voice) * t) * beat + voice * 0.01 * rng.standard_normal(n)
        x += 1e-5 * rng.standard_normal(len(x))
        out[name] = (x, turns)
    return out


@pytest.fixture(scope="module")
def made(spark):
    held = calls()
    files = spark.createDataFrame([(n, bytearray(wav(x, RATE))) for n, (x, _) in held.items()] + [("mute", bytearray(wav(np.zeros(RATE), RATE)))], "path string, content binary")
    rows = audio.decode(files, RATE, row_samples=ROW).cache()
    script = ["Thank you for calling, how can I help", "please hold", "have a great day", "speaking with"]
    plainly = ["I want my car back", "why is it late", "can you hurry"]
    said, wins, regions, vector = [], [], [], {0: [1.0, 0.0, 0.1], 1: [0.1, 1.0, 0.0]}
    for n, (_, turns) in held.items():
        for k, (a, b, voice) in enumerate(turns):
            regions.append((n, a, b))
            text = (script[k % 4] if voice == 0 else plainly[k % 3]) if n == "words" else "hm"
            said.append((n, a, b, text, [v + 0.01 * k for v in vector[voice]]))
            wins += [(n, a + 0.6 * j, min(a + 0.6 * j + 1.25, b), [v + 0.003 * j for v in vector[voice]]) for j in range(2)]
    utterances = spark.createDataFrame(said, "file_id string, start_s double, end_s double, text string, embedding array<double>")
    windows = spark.createDataFrame(wins, "file_id string, start_s double, end_s double, embedding array<double>")
    speech = spark.createDataFrame([(n, sum(b - a for a, b, _ in turns)) for n, (_, turns) in held.items()] + [("mute", 0.0)], "file_id string, speech_s double")
    return held, rows, speech, spark.createDataFrame(regions, "file_id string, start_s double, end_s double"), windows, utterances


def quantised(x):
    return ((np.clip(x, -1, 1) * 32767).astype("<i2") / 32768.0).astype(np.float32)


def plain_floor(x, spans):
    frames = [np.lib.stride_tricks.sliding_window_view(x[int(a * RATE) : int(b * RATE)].astype(float), 320)[::160] for a, b in spans]
    rms = np.concatenate([np.sqrt((f**2).mean(axis=1)) for f in frames])
    return 20 * np.log10(max(np.percentile(rms, 10), 1e-10))


def plain_spread(x, spans):
    return float(np.std([20 * np.log10(max(np.sqrt((x[int(a * RATE) : int(b * RATE)].astype(float) ** 2).mean()), 1e-10)) for a, b in spans]))


def test_levels_of_clusters_over_row_borders(made, spark):
    held, rows, *_ = made
    spans = [(n, k % 2, k, a, b) for n, (_, turns) in held.items() for k, (a, b, _) in enumerate(turns)] + [("words", 2, 99, 11.9, 50.0)]
    frame = spark.createDataFrame(spans, "file_id string, cluster int, win long, start_s double, end_s double")
    found = {(r["file_id"], r["cluster"]): r for r in samples.cluster_levels(samples.window_levels(rows, frame, RATE, ROW)).collect()}
    for n, (x, turns) in held.items():
        for c in (0, 1):
            own = [(a, b) for k, (a, b, _) in enumerate(turns) if k % 2 == c]
            assert abs(found[n, c]["floor_db"] - plain_floor(quantised(x), own)) < 1e-3 and abs(found[n, c]["level_sd"] - plain_spread(quantised(x), own)) < 1e-3
    assert ("words", 2) in found


def test_cascade_of_roles(made):
    held, rows, speech, regions, windows, utterances = made
    found, spans = roles.customer(rows, speech, regions, windows, utterances, ROW)
    got = {r["file_id"]: r for r in found.collect()}
    assert {n: r["how"] for n, r in got.items()} == {"words": "lexical", "sound": "acoustic", "single": "one voice", "mute": "silent"}
    assert {n: r["n_speakers"] for n, r in got.items()} == {"words": 2, "sound": 2, "single": 1, "mute": 0}
    x, turns = held["words"]
    customer = sorted((a, b) for a, b, voice in turns if voice == 1)
    assert sorted((round(r["start_s"], 6), round(r["end_s"], 6)) for r in spans.where("file_id = 'words'").collect()) == [(round(a, 6), round(b, 6)) for a, b in customer]
    texts = {v: " ".join(r["text"] for r in utterances.where("file_id = 'words'").orderBy("start_s").collect()[v::2]) for v in (0, 1)}
    votes = {v: sum(bool(re.search("(?i)" + p, t)) for p in AGENT_PATTERNS) - sum(bool(re.search("(?i)" + p, t)) for p in CUSTOMER_PATTERNS) for v, t in texts.items()}
    assert votes[0] >= 3 > 0 > votes[1]  # the customer's floor is the higher one, too
    assert abs(got["words"]["role_confidence"] - min(0.95, np.clip((votes[0] - votes[1]) / 4, 0.15, 0.9) + 0.15)) < 1e-4
    x, turns = held["sound"]
    wins = {v: [(a + 0.6 * j, min(a + 0.6 * j + 1.25, b)) for a, b, voice in turns if voice == v for j in range(2)] for v in (0, 1)}
    floor, spread = ({v: f(quantised(x), wins[v]) for v in (0, 1)} for f in (plain_floor, plain_spread))
    score = {v: np.clip((floor[v] - floor[1 - v]) / 12, -1, 1) + 0.45 * np.clip((spread[v] - spread[1 - v]) / 6, -1, 1) - 0.3 * (v == 0) for v in (0, 1)}
    assert score[1] > score[0] and abs(got["sound"]["role_confidence"] - round(min(1.0, (score[1] - score[0]) / 1.75), 4)) < 2e-3
    assert abs(got["sound"]["customer_speech_s"] - sum(b - a for a, b in wins[1])) < 0.02 and got["single"]["role_confidence"] == 0.35
    assert abs(got["single"]["customer_speech_s"] - sum(b - a for a, b, _ in held["single"][1])) < 0.02 and got["mute"]["customer_speech_s"] == 0.0


def test_cut_to_spans(made, spark):
    held, rows, *_ = made
    spans = [("words", 0.3, 1.1), ("words", 1.0, 2.5), ("words", 5.0, 5.0), ("words", 8.01, 99.0), ("sound", 2.0, 2.001), ("single", 50.0, 60.0)]
    frame = spark.createDataFrame(spans, "file_id string, start_s double, end_s double")
    for tail in (8192, 100_000):
        found = samples.cut_to(rows, frame, RATE, ROW, tail).collect()
        for n, (x, _) in held.items():
            mask = np.zeros(len(x), bool)
            for f, a, b in spans:
                if f == n:
                    mask[int(a * RATE) : min(len(x), int(b * RATE))] = True
            want = quantised(x)[mask] if mask.any() else quantised(x)
            own = sorted((r for r in found if r["path"] == n), key=lambda r: r["first"])
            assert np.array_equal(np.concatenate([r["samples"] for r in own]), want) and {r["length"] for r in own} == {len(want)}
            if mask.any():
                for r in own:
                    assert np.array_equal(r["tail"], want[r["first"] + ROW : r["first"] + ROW + tail])


def test_tone_of_the_customer(made, spark):
    held, rows, speech, regions, windows, utterances = made
    spans = spark.createDataFrame([("words", a, b) for a, b, voice in held["words"][1] if voice == 1], "file_id string, start_s double, end_s double")
    classes = spark.createDataFrame([("words", "ang", 0.7), ("words", "neu", 0.3), ("sound", "hap", 1.0), ("mute", "ang", 1.0)], "file_id string, label string, p double")
    words = spark.createDataFrame([("words", -0.5), ("sound", 0.9), ("single", 0.4), ("mute", 1.0)], "file_id string, lexical double")
    sure = spark.createDataFrame([("words", 0.2), ("sound", 0.8)], "file_id string, role_confidence double")
    got = {r["file_id"]: r for r in tone.customer_tone(rows, speech, spans, classes, words, sure, ROW).collect()}
    cut = np.concatenate([quantised(held["words"][0])[int(a * RATE) : int(b * RATE)] for a, b, voice in held["words"][1] if voice == 1])
    alone = prosody(audio.decode(spark.createDataFrame([("words", bytearray(wav(cut * 32768 / 32767, RATE)))], "path string, content binary"), RATE)).first()["arousal"]
    whole = {r["file_id"]: r["arousal"] for r in prosody(rows).collect()}
    for n, prosodic, place, lexical, factor in (("words", alone, (-0.49, 2 * (0.7 * 0.85 + 0.03) - 1), -0.5, 0.7), ("sound", whole["sound"], (0.7, 0.1), 0.9, 1.0), ("single", whole["single"], None, 0.4, 1.0)):
        arousal = prosodic if place is None else (prosodic + place[1]) / 2
        acoustic = None if place is None else place[0]
        asked = arousal >= 0.3 or abs(acoustic or 0.0) < 0.35
        valence = (lexical if acoustic is None else 0.35 * acoustic + 0.65 * lexical) if asked else acoustic
        source = ("lexical" if acoustic is None else "fused") if asked else "acoustic"
        assert abs(got[n]["arousal"] - np.clip(arousal * factor, -1, 1)) < 2e-3 and abs(got[n]["valence"] - np.clip(valence * factor, -1, 1)) < 1e-3, n
        assert got[n]["valence_source"] == source
    assert (got["mute"]["arousal"], got["mute"]["valence"], got["mute"]["valence_source"]) == (0.0, 0.0, "none")
