"""Uploads with damaged members, and the search of thresholds against a plain descent."""

import io
import json
import random
import zipfile

import pytest
from recordlens.config import Thresholds, read_thresholds, write_thresholds
from recordlens.operators import jobs, tune
from recordlens.plans import tuning
from recordlens.sources import archive


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as file:
        for name, content in members.items():
            file.writestr(name, content)
    return out.getvalue()


def cell(**fields):
    return '"' + json.dumps(fields).replace('"', '""') + '"'


def test_mixed_upload(spark):
    good = zipped({"calls/a.wav": b"AAAA-audio", "calls/b.wav": b"BBBB-audio", "calls/labels.csv": "x,y\n1,2\n", "__MACOSX/a.wav": b"junk", "notes.txt": "n", "deep/er/inner.zip": b"z"})
    damaged = bytearray(good)
    at = damaged.find(b"BBBB-audio")
    damaged[at] ^= 255  # the checksum no longer fits
    labels = "\ufeffname,result_json\n" + f"other/a.wav,{cell(audio_quality='clear')}\n,{cell(audio_quality='clear')}\nb.wav,{{broken\na.wav,\nz.wav,{cell(emotional_tone='upset')}\nz.wav,{cell(emotional_tone='neutral')}\n"
    files = [("up/good.zip", damaged), ("up/bad.zip", b"no archive"), ("up/evil.zip", zipped({"../x.wav": b"1"})), ("up/later/labels.csv", labels.encode()), ("up/c.WAV", b"C"), ("up/._c.wav", b"j"), ("up/empty.csv", b""), ("up/odd.csv", b"\xff\xfe")]
    staged = archive.stage(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).cache()
    kinds = {r["path"]: (r["kind"], bool(r["problem"])) for r in staged.collect()}
    assert kinds == {
        "up/good/calls/a.wav": ("audio", False), "up/good/calls/b.wav": ("broken", True), "up/good/calls/labels.csv": ("manifest", False), "up/good/notes.txt": ("skipped", False),
        "up/good/deep/er/inner.zip": ("skipped", False), "up/bad.zip": ("broken", True), "up/evil.zip": ("refused", True), "up/later/labels.csv": ("manifest", False), "up/c.WAV": ("audio", False),
        "up/._c.wav": ("junk", False), "up/empty.csv": ("manifest", False), "up/odd.csv": ("manifest", False),
    }
    assert {r["path"]: r["label"] for r in archive.staged_names(staged).collect()} == {"up/good/calls/a.wav": "a.wav", "up/c.WAV": "c.WAV"}
    truth = {r["name"]: r["truth"] for r in archive.staged_labels(staged).collect()}
    assert set(truth) == {"a.wav", "z.wav"} and truth["a.wav"]["audio_quality"] == "clear" and truth["z.wav"]["emotional_tone"] == "neutral"
    assert archive.stage(staged.limit(0).select("path", "content")).count() == 0


def plain_descent(rows, search, start, k, passes):
    """All rows scored anew for each candidate: rows are (grp, {field: truth}, value)."""
    groups = {g: n % k for n, g in enumerate(sorted({g for g, _, _ in rows}))}

    def f1(pairs):
        classes = {c for p in pairs for c in p}
        out = []
        for c in classes:
            tp, t, s = (sum(x) for x in ([a == b == c for a, b in pairs], [a == c for a, _ in pairs], [b == c for _, b in pairs]))
            out.append(2 * tp / (t + s))
        return sum(out) / len(out)

    def score(edges):
        folds = {}
        for g, truth, value in rows:
            reached = 0 if value is None else sum(value >= e for e in edges)
            for field, labels in search.fields:
                if field in truth:
                    folds.setdefault(groups[g], {}).setdefault(field, []).append((truth[field], labels[reached]))
        return sum(sum(map(f1, fields.values())) / len(fields) for fields in folds.values()) / len(folds)

    edges = [float(start[p]) for p in search.params]
    before = best = score(edges)
    for _ in range(passes):
        for j, grid in enumerate(search.grids):
            for c in grid:
                if (j == 0 or c > edges[j - 1]) and (j + 1 == len(edges) or c < edges[j + 1]):
                    tried = [*edges[:j], float(c), *edges[j + 1 :]]
                    if score(tried) > best + 1e-12:
                        best, edges = score(tried), tried
    return dict(zip(search.params, edges)), (before, best)


@pytest.mark.parametrize("k, passes", [(3, 2), (1, 1)])
def test_coordinate_descent(spark, k, passes):
    draw = random.Random(k)
    start = {"a": -70.0, "b": -20.0, "c": 5.0}
    first = tune.Search("noise", "x", ("a", "b"), (tuple(range(-80, -40, 4)), tuple(range(-50, 0, 6))), (("level", ("low", "medium", "high")), ("there", ("no", "yes", "yes"))))
    second = tune.Search("silence", "y", ("c",), ((4, 8, 12, 16),), (("quiet", ("no", "yes")),))
    rows, noise, silence = [], [], []
    for _ in range(500):
        value, g = draw.uniform(-90, 0), f"g{draw.randrange(17)}"
        truth = {"level": "low" if value < -55 else "medium" if value < -30 else "high"} | ({"there": "no" if value < -55 else "yes"} if draw.random() < 0.7 else {})
        value = None if draw.random() < 0.05 else round(value, 1)
        noise.append((g, truth, value))
        rows += [(g, field, t, value) for field, t in truth.items()]
        seconds = draw.uniform(0, 20)
        silence.append((g, {"quiet": "yes" if (seconds > 11) != (draw.random() < 0.1) else "no"}, seconds))
        rows.append((g, "quiet", silence[-1][1]["quiet"], seconds))
    frame = spark.createDataFrame(rows + [("g1", "unasked", "x", 1.0)], "grp string, field string, truth string, value double").repartition(5)
    found, report = tune.descend(frame, (first, second), start, k, passes)
    for search, own in ((first, noise), (second, silence)):
        edges, (before, after) = plain_descent(own, search, start, k, passes)
        assert {p: found[p] for p in search.params} == edges and edges != {p: start[p] for p in search.params}
        assert abs(report[search.name][0] - before) < 1e-9 and abs(report[search.name][1] - after) < 1e-9
    assert tune.descend(frame.limit(0), (first,), start, k) == (start, {"noise": (0.0, 0.0)})


def test_thresholds_from_labelled_recordings(spark, tmp_path):
    """Estimates whose labels follow other thresholds than the defaults lead to those, and into the YAML."""
    draw = random.Random(9)
    estimates, labels, groups = [], [], []
    for n in range(400):
        db, score, quiet = draw.uniform(-75, -5), draw.random(), draw.uniform(0, 25)
        severity = "none" if db < -58 else "low" if db < -46 else "medium" if db < -30 else "high"
        truth = (severity != "none", severity, "clear" if score < 0.35 else "slightly_impaired" if score < 0.7 else "severely_impaired", quiet >= 14 if n % 3 else None)
        estimates.append((f"{n}.wav", db, score, quiet))
        labels.append((f"{n}.wav", truth))
        if n % 10:
            groups.append((f"{n}.wav", f"s{n % 7}|n{n % 5}"))
    kind = "name string, truth struct<background_noise_present: boolean, background_noise_severity: string, audio_quality: string, long_silence_present: boolean>"
    found, report = tuning.tuned(
        spark.createDataFrame(estimates, "name string, noise_level_db double, degradation_score double, max_silence_s double"),
        spark.createDataFrame(labels + [("absent.wav", (True, "low", None, None))], kind), spark.createDataFrame(groups, "name string, grp string"),
    )
    assert (found.noise_present_db, found.noise_medium_db, found.noise_high_db) == (-58.0, -46.0, -30.0)
    assert abs(found.quality_slight - 0.35) <= 0.025 and abs(found.quality_severe - 0.7) <= 0.025 and found.long_silence_s == 14.0
    assert all(after > before and after > 0.95 for before, after in report.values()) and found.arousal_low == Thresholds().arousal_low
    place = tmp_path / "t.yaml"
    place.write_text("noise: {present_db: -42.0, extra: 1}\n")
    write_thresholds(place, found)
    assert read_thresholds(place) == found and "extra" in place.read_text()


def test_folds_are_numbered_by_ranges(spark):
    groups = spark.createDataFrame([(f"g{n % 997:04d}",) for n in range(5000)], "grp string").repartition(7)
    assert {(r["grp"], r["fold"]) for r in tune.folds(groups, 5).collect()} == {(f"g{n:04d}", n % 5) for n in range(997)}
    plan = tune.folds(groups, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" in plan.replace("windowspec", "") and "_part" in plan


def test_stage_totals_run_nothing_while_planned(spark):
    results = spark.createDataFrame([({"vad": 1.0, "asr": 3.0}, 10.0), ({"vad": 1.0}, 10.0)], "stage_times map<string,double>, audio_s double")
    assert [(r["stage"], r["rtf"]) for r in jobs.stage_totals(results).collect()] == [("asr", 0.15), ("vad", 0.1)]
