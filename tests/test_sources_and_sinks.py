"""Files in and out: manifests, archives, WAV, YAML, JSON and CSV; streams."""

import io
import json
import wave
import zipfile
from dataclasses import replace

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F
from recordlens import cli, sinks
from recordlens.config import TUNED, Thresholds, from_mapping, read_thresholds, to_mapping, write_thresholds
from recordlens.operators import jobs, quality, samples, windows
from recordlens.plans.impairment import impairments
from recordlens.plans.pipeline import ORDER, Estimates, Stub, analyse, build, requested
from recordlens.plans.prosody import prosody
from recordlens.sources import archive, audio, manifest, pcm
from recordlens.streaming.sessions import sessions


def wav(x: np.ndarray, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1 if x.ndim == 1 else x.shape[1])
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_thresholds(tmp_path):
    assert from_mapping({"noise": {"present_db": "-53"}, "quality": None, "emotion": {"arousal_low": "x"}}) == replace(Thresholds(), noise_present_db=-53.0)
    path = tmp_path / "t.yaml"
    assert read_thresholds(path) == Thresholds()
    path.write_text("other: 1\nnoise: {extra: 2}\n")
    write_thresholds(path, TUNED)
    assert read_thresholds(path) == TUNED and yaml.safe_load(path.read_text())["noise"]["extra"] == 2
    assert from_mapping(to_mapping(TUNED)) == TUNED
    path.write_text("a: [")
    assert read_thresholds(path) == Thresholds()


def test_labels(spark, tmp_path):
    good = json.dumps({"emotional_tone": "upset", "confidence": 0.5})
    quoted = '"' + good.replace('"', '""') + '"'
    path = tmp_path / "labels.csv"
    path.write_text("﻿name,result_json\n" + f"a.wav,{quoted}\nb.wav,{{broken\n,{quoted}\nc.wav,\na.wav,\"{{\"\"emotional_tone\"\": \"\"neutral\"\"}}\"\n", encoding="utf-8")
    found = {r["name"]: r["truth"]["emotional_tone"] for r in manifest.read_labels(spark, str(path)).collect()}
    assert found == {"a.wav": "neutral"}


def test_names(spark):
    paths = ["u.d/x/a.wav", "u.d/y/a.wav", "v.d/x/a.wav", "u.d/b.wav", "__MACOSX/._b.wav", "u.d/n.TXT", "u.d/m.csv", "C:\\up\\c.Ogg", "u.d/.hidden"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kinds = {r["path"]: r["k"] for r in files.select("path", manifest.classify(F.col("path")).alias("k")).collect()}
    assert [kinds[p] for p in paths] == ["audio", "audio", "audio", "audio", "junk", "skipped", "manifest", "audio", "skipped"]
    shown = {r["path"]: r["label"] for r in manifest.display_names(files.where("path like '%/a.wav' or path like '%/b.wav'").where("path not like '%MACOSX%'")).collect()}
    assert shown == {"u.d/x/a.wav": "x/a.wav", "u.d/y/a.wav": "y/a.wav", "v.d/x/a.wav": "a (1).wav", "u.d/b.wav": "b.wav"}


def test_archives(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/b.wav", b"x")
        z.writestr("__MACOSX/._b.wav", b"0" * 10_000_000)
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../evil.wav", b"x")
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("z.wav", b"0" * 5_000_000)
    files = spark.createDataFrame([("ok", held.getvalue()), ("bad", bad.getvalue()), ("bomb", bomb.getvalue()), ("no", b"text")], "path string, content binary")
    found = {r["archive"]: r["problem"] for r in archive.verdicts(archive.members(files)).collect()}
    assert found == {"ok": None, "bad": "unsafe path", "bomb": "implausible compression", "no": "not an archive"}
    assert [(r["archive"], r["member"], bytes(r["content"])) for r in archive.extract(files).collect()] == [("ok", "a/b.wav", b"x")]


def test_wav(spark):
    t = np.arange(16000) / 16000
    tone = 0.5 * np.sin(2 * np.pi * 200 * t)
    files = spark.createDataFrame([("tone", wav(tone)), ("stereo", wav(np.stack([tone, -tone], 1))), ("text", b"hello"), ("none", b""), ("empty", wav(tone[:0]))], "path string, content binary")
    heads = {r["path"]: r for r in audio.probe(files).collect()}
    assert heads["tone"]["duration_s"] == 1.0 and heads["stereo"]["channels"] == 2
    assert all(heads[p]["error"] for p in ("text", "none", "empty"))
    decoded = audio.decode(files).cache()
    f0 = [r["f0"] for r in audio.voice_frames(decoded, 0.04, 0.02).where("file_id = 'tone' and f0 is not null").collect()]
    assert len(f0) > 10 and abs(np.median(f0) - 200) < 5
    shape = {r["file_id"]: r for r in windows.spectral_shape(audio.mean_spectrum(decoded), 1000.0, 4000.0).collect()}
    assert shape["tone"]["low_share"] > 0.95 and shape["tone"]["flatness"] < 0.01
    assert audio.frame_levels(decoded, 400, 160).where("file_id = 'tone'").count() == (16000 - 400) // 160 + 1
    slow = audio.decode(files, 8000).where("path = 'tone'").first()
    assert slow["rate"] == 8000 and len(slow["samples"]) == 8000 and abs(np.std(slow["samples"]) - 0.3535) < 0.01
    stereo = {r["file_id"]: r for r in windows.channel_correlation(audio.stereo_samples(files)).collect()}
    assert list(stereo) == ["stereo"] and stereo["stereo"]["true_stereo"] and abs(stereo["stereo"]["channel_corr"] + 1) < 1e-3
    assert audio.modulation(np.sin(2 * np.pi * 4 * np.arange(500) / 100), 100) > 0.9
    noisy = audio.mix_at_snr(tone, np.random.default_rng(0).standard_normal(1000), 10.0)
    assert np.abs(noisy).max() <= 0.9500001


def test_frames_over_row_borders(spark):
    """Rows of a long file give the frames of one pass over all of its samples."""
    x = np.random.default_rng(3).standard_normal(3 * pcm.ROW_SAMPLES + 777) * 0.1
    decoded = audio.decode(spark.createDataFrame([("long", bytearray(wav(x)))], "path string, content binary")).cache()
    assert decoded.count() == 4
    mono = np.concatenate([r["samples"] for r in decoded.orderBy("first").collect()]).astype(float)
    assert len(mono) == len(x)
    windows_ = np.lib.stride_tricks.sliding_window_view(mono, 400)[::160]
    levels = {r["i"]: r["rms"] for r in audio.frame_levels(decoded, 400, 160).collect()}
    assert np.allclose([levels[i] for i in range(len(windows_))], np.sqrt((windows_**2).mean(axis=1))) and len(levels) == len(windows_)
    hz = audio.spectrum(mono, 16000, slice(0, 1))[0]
    mean = {r["hz"]: r["power"] for r in audio.mean_spectrum(decoded, 512).collect()}
    assert np.allclose([mean[h] for h in hz], audio.spectrum(mono, 16000, slice(None, None, 512))[1].mean(axis=0))
    tone = np.sin(2 * np.pi * 150 * np.arange(2 * pcm.ROW_SAMPLES) / 16000)
    steady = audio.voice_frames(audio.decode(spark.createDataFrame([("tone", bytearray(wav(tone)))], "path string, content binary")), 0.04, 0.02).where("f0 is not null")
    assert [r["i"] for r in steady.orderBy("i").collect()] == list(range((len(tone) - 640) // 320 + 1))


def test_files_cut_short(spark):
    """A file that lacks bytes gives what it has, one that can't be decoded an error; neither ends the job."""
    whole = wav(np.stack([np.ones(1000), np.ones(1000)], 1) * 0.5)
    odd = bytearray(whole)
    odd[34:36] = (40).to_bytes(2, "little")  # bits a sample
    files = spark.createDataFrame([("short", bytearray(whole[:-3])), ("bare", bytearray(whole[:44])), ("odd", odd), ("good", bytearray(whole)), ("none", None)], "path string, content binary")
    found = {r["path"]: (len(r["samples"]), bool(r["error"])) for r in audio.decode(files).collect()}
    assert found == {"short": (999, False), "bare": (0, True), "odd": (0, True), "good": (1000, False), "none": (0, True)}
    assert {r["file_id"] for r in audio.stereo_samples(files).select("file_id").distinct().collect()} == {"short", "good"}


def test_holes_against_speech_only(spark):
    """A loud pause doesn't raise the floor of holes: 0.02 lies under it only against the whole file."""
    rows = [(1, i, 0.1 if i < 100 else 50.0) for i in range(200)]
    rows = [(f, i, 0.02 if 40 <= i < 46 else v) for f, i, v in rows]
    frames = spark.createDataFrame(rows, "file_id long, i long, rms double")
    speech = spark.createDataFrame([(1, 0.0, 1.0)], "file_id long, start_s double, end_s double")
    assert quality.dropouts(frames, speech, 0.01).count() == 0
    deep = frames.replace(0.02, 0.0001, "rms")
    assert quality.dropouts(deep, speech, 0.01).count() == 1


def test_holes_in_speech(spark):
    holes = spark.createDataFrame([(1, i, 1e-6 if 40 <= i < 46 else 0.1) for i in range(100)], "file_id long, i long, rms double")
    speech = spark.createDataFrame([(1, 0.0, 1.0)], "file_id long, start_s double, end_s double")
    assert quality.dropouts(holes, speech, 0.01).count() == 1


def test_bandwidth(spark):
    wide = np.random.default_rng(1).standard_normal(48000) * 0.1
    power = np.fft.rfft(wide)
    power[np.fft.rfftfreq(48000, 1 / 48000) > 3000] = 0
    narrow = np.fft.irfft(power)
    files = [("wide", wav(wide, 48000)), ("narrow", wav(narrow, 48000)), ("phone", wav(wide[:8000], 8000)), ("short", wav(wide[:100], 48000))]
    decoded = audio.decode(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"), None, samples.TAIL_S, samples.ROW_SAMPLES)
    scores = {r["file_id"]: r for r in impairments(samples.measured_rows(decoded), decoded).collect()}
    found = {n: r["bandwidth"] for n, r in scores.items()}
    assert found["wide"] == 0.0 and found["narrow"] == 1.0 and 0.5 < found["phone"] < 0.56 and found["short"] == 0.0
    assert scores["wide"]["degradation_score"] < 0.1 < scores["phone"]["degradation_score"] < scores["narrow"]["degradation_score"]


def test_pipeline_and_sinks(spark, tmp_path):
    assert requested("all") == list(ORDER) and requested("none") == ["stub"] and requested("noise, vad,x") == ["vad", "noise"]

    def broken():
        raise RuntimeError("no model")

    names = spark.createDataFrame([("a.wav", None, 1.0, 30.0), ("b.wav", "unreadable", 0.1, 0.0)], "name string, error string, elapsed_s double, audio_s double")
    table = spark.createDataFrame([("a.wav", -40.0, 0.1)], "name string, noise_level_db double, degradation_score double")
    stages = build("noise,quality,stub", {"noise": lambda: Estimates("noise", table, "noise_level_db", "degradation_score"), "quality": broken, "stub": Stub})
    assert [s.name for s in stages] == ["noise", "stub"]
    out = analyse(names, stages).withColumn("stage_times", F.create_map(F.lit("noise"), F.lit(0.123456)))
    rows = {r["name"]: r for r in out.collect()}
    assert rows["a.wav"]["status"] == "ok" and rows["a.wav"]["background_noise_severity"] == "medium" and rows["b.wav"]["status"] == "failed"
    sinks.write_json(out, str(tmp_path / "j"), single=False)
    read = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert {r["name"]: r["rtf"] for r in read} == {"a.wav": 0.0333, "b.wav": None}
    assert next(r for r in read if r["name"] == "a.wav")["stage_times"] == {"noise": 0.1235}
    sinks.write_csv(out, str(tmp_path / "c"), wide=True)
    sinks.write_supplied(out, str(tmp_path / "s"))
    again = manifest.read_labels(spark, str(tmp_path / "s"))
    assert again.first()["truth"]["background_noise_severity"] == "medium"


def test_stages_are_observed_while_the_job_runs(spark):
    names = spark.createDataFrame([(f"{k}.wav", None) for k in range(10)], "name string, error string")
    table = spark.createDataFrame([(f"{k}.wav", -40.0 if k % 2 else None) for k in range(8)], "name string, noise_level_db double")
    observed, told = {}, []
    out = analyse(names, [Estimates("noise", table, "noise_level_db"), Stub()], on_stage=told.append, observed=observed)
    assert told == ["noise", "stub"] and out.count() == 10
    assert observed["noise"].get == {"recordings": 10, "noise_level_db": 4}


def test_jobs(spark):
    results = spark.createDataFrame([({"vad": 1.0, "asr": 3.0}, 10.0), ({"vad": 1.0}, 10.0)], "stage_times map<string,double>, audio_s double")
    assert {r["stage"]: r["rtf"] for r in jobs.stage_totals(results).collect()} == {"vad": 0.1, "asr": 0.15}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "calls" / "sub").mkdir(parents=True)
    # a tone alone ends below 3.6 kHz and counts as narrow; the noise gives it a band to be clear in
    tone = 0.3 * np.sin(np.arange(16000) / 10) + 0.03 * np.random.default_rng(3).standard_normal(16000)
    (tmp_path / "calls" / "a.wav").write_bytes(wav(tone))
    (tmp_path / "calls" / "sub" / "b.WAV").write_bytes(b"no audio")
    (tmp_path / "calls" / "note.txt").write_text("x")
    quoted = '"' + json.dumps({"audio_quality": "clear", "emotional_tone": "upset"}).replace('"', '""') + '"'
    (tmp_path / "labels.csv").write_text(f"name,result_json\na.wav,{quoted}\nz.wav,{quoted}\n")
    code = cli.main([str(tmp_path / "calls"), "--labels", str(tmp_path / "labels.csv"), "--out", str(tmp_path / "out")], spark)
    assert code == 0
    whole = json.loads((tmp_path / "out" / "results.json").read_text())
    read = {r["name"]: r for r in whole["results"]}
    assert whole["score_report"]["fields"]["audio_quality"] == {"n": 1, "accuracy": 1.0, "adjacent_accuracy": 1.0, "macro_f1": 1.0, "errors": []}
    assert whole["score_report"]["fields"]["emotional_tone"]["errors"][0]["truth"] == "upset" and whole["score_report"]["mean_field_accuracy"] == 0.5
    assert (tmp_path / "out" / "results.csv").read_bytes().startswith("\ufeffname,status,result_json,error\r\na.wav,ok,".encode())
    assert read["a.wav"]["status"] == "ok" and read["b.WAV"]["status"] == "failed" and read["b.WAV"]["error"]
    assert set(read["a.wav"]["stage_times"]) == {"quality", "noise", "emotion"} and read["a.wav"]["rtf"] > 0 and read["b.WAV"]["stage_times"] is None
    said = capsys.readouterr().out
    assert "quality: 1 of 2 degradation_score" in said and "missing prediction: 1" in said
    scores = {r["field"]: r["accuracy"] for r in spark.read.parquet(str(tmp_path / "out" / "scores.parquet")).collect()}
    assert scores == {"audio_quality": 1.0, "emotional_tone": 0.0}
    assert cli.main([str(tmp_path / "none")], spark) == 1


def test_command_line_with_models_outside(spark, tmp_path):
    """Regions, windows, utterances, classes and words given: dropouts, roles and tone are measured too."""
    rng, t = np.random.default_rng(6), np.arange(16000 * 8) / 16000
    (tmp_path / "in").mkdir()
    speech = [(0.5 + 1.8 * k, 2.0 + 1.8 * k, k % 2) for k in range(4)]
    x = 1e-4 * rng.standard_normal(len(t))
    for a, b, voice in speech:
        n = int(b * 16000) - int(a * 16000)
        x[int(a * 16000) : int(a * 16000) + n] += (0.1 + 0.1 * voice) * np.sin(2 * np.pi * (150 + 80 * voice) * t[:n]) + 0.02 * rng.standard_normal(n)
    holed = x.copy()
    for a, b, _ in speech:
        for at in np.arange(a + 0.1, b - 0.1, 0.15):
            holed[int(at * 16000) : int(at * 16000) + 400] = 0.0
    (tmp_path / "in" / "good.wav").write_bytes(wav(x))
    (tmp_path / "in" / "holes.wav").write_bytes(wav(holed))
    rows = {what: [] for what in ("regions", "windows", "utterances", "classes", "words")}
    for n in ("good.wav", "holes.wav"):
        rows["classes"] += [(n, "ang", 0.4), (n, "neu", 0.6)]
        rows["words"].append((n, -0.9))
        for k, (a, b, voice) in enumerate(speech):
            vec = [1.0, 0.1 * k] if voice else [0.05 * k, 1.0]
            rows["regions"].append((n, a, b))
            rows["windows"] += [(n, a + 0.6 * j, a + 0.6 * j + 0.9, vec) for j in range(2)]
            rows["utterances"].append((n, a, b, "I want my car" if voice else "thank you for calling, how can I help", vec))
    kinds = {"regions": "start_s double, end_s double", "windows": "start_s double, end_s double, embedding array<double>", "utterances": "start_s double, end_s double, text string, embedding array<double>", "classes": "label string, p double", "words": "lexical double"}
    for what, held in rows.items():
        spark.createDataFrame(held, f"name string, {kinds[what]}").write.parquet(str(tmp_path / what))
    code = cli.main([str(tmp_path / "in"), "--out", str(tmp_path / "out"), *[x for what in rows for x in (f"--{what}", str(tmp_path / what))]], spark)
    assert code == 0
    found = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out" / "results.parquet")).collect()}
    assert found["holes.wav"]["degradation_score"] > found["good.wav"]["degradation_score"] + 0.5
    for r in found.values():
        assert r["n_speakers"] == 2 and r["role_confidence"] > 0.5 and abs(r["customer_speech_s"] - 3.0) < 0.02
        assert r["valence_source"] == "fused" and r["valence"] < -0.6 and abs(r["speech_ratio"] - 0.75) < 1e-6 and r["noise_level_db"] is not None


@pytest.mark.parametrize("late", [None, "1 hour"])
def test_sessions(spark, tmp_path, late):
    rows = [(1, f"2024-01-01 00:0{m}:00") for m in (0, 1, 2, 8, 9)] + [(2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    if late:
        events.write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        run = sessions(stream, "5 minutes", late).writeStream.outputMode("complete").format("memory").queryName("sess").trigger(availableNow=True).start()
        run.awaitTermination()
        found = spark.table("sess")
    else:
        found = sessions(events, "5 minutes")
    assert sorted((r["user_id"], r["n_events"]) for r in found.collect()) == [(1, 2), (1, 3), (2, 1)]


def test_equal_base_names(spark, tmp_path):
    """Files of one name in two folders are two recordings, shown by their paths."""
    quiet, loud = (np.sin(np.arange(32000) / 20) * gain for gain in (0.0005, 0.5))
    for folder, x in (("a", quiet), ("b", loud)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.wav").write_bytes(bytes(wav(x)))
    (tmp_path / "in" / "a" / "y.wav").write_bytes(bytes(wav(loud)))
    assert cli.main([str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--stack", "quality"], spark) == 0
    found = spark.read.parquet(str(tmp_path / "out" / "results.parquet"))
    quality_of = {r["name"]: r["audio_quality"] for r in found.collect()}
    assert set(quality_of) == {"a/x.wav", "b/x.wav", "y.wav"} and quality_of["a/x.wav"] != quality_of["b/x.wav"] == quality_of["y.wav"]


def plain_prosody(x: np.ndarray) -> tuple[float, float, float, float]:
    """Spread of level and pitch, rate and tilt of one recording, frame after frame."""
    frames = [x[k : k + 400] for k in range(0, len(x) - 399, 160)]
    rms = np.array([np.sqrt(np.mean(f**2)) for f in frames])
    db = 20 * np.log10(np.maximum(rms, 1e-10))
    voiced = [k for k in range(len(frames)) if db[k] > np.percentile(db, 90) - 25]
    tones = []
    for k in voiced[:: max(1, len(voiced) // 120)]:
        f = frames[k] - frames[k].mean()
        alike = [np.dot(f[: 400 - lag], f[lag:]) / np.dot(f, f) for lag in range(50, 228)]
        if max(alike) > 0.3:
            tones.append(16000 / (50 + int(np.argmax(alike))))
    pitch = np.std(12 * np.log2(np.array(tones) / np.median(tones))) if len(tones) >= 4 else 0.0
    spectrum = np.abs(np.fft.rfft((rms - rms.mean()) * np.hanning(len(rms))))
    hz = np.fft.rfftfreq(len(rms), 0.01)
    mean = np.mean([np.abs(np.fft.rfft(frames[k] * np.hanning(400))) for k in voiced], axis=0)
    bins = np.arange(201) * 40
    tilt = np.log10(mean[(bins >= 1000) & (bins < 4000)].sum() / mean[(bins >= 100) & (bins < 1000)].sum()) + 1
    return np.std(db[voiced]), pitch, spectrum[(hz >= 2) & (hz <= 8)].sum() / spectrum.sum(), np.clip(tilt, -1, 1)


def test_prosody(spark):
    """Over row borders as in one pass; short, silent and unreadable recordings have defined results."""
    t, rng = np.arange(150_000) / 16000, np.random.default_rng(2)
    voice = 0.4 * np.sin(2 * np.pi * (140 * t + 3 * np.sin(2 * np.pi * 0.7 * t))) * (0.55 + 0.45 * np.sin(2 * np.pi * 4 * t)) + 0.01 * rng.standard_normal(len(t))
    files = [("voice", wav(voice)), ("short", wav(voice[:7000])), ("silent", wav(np.zeros(20_000))), ("text", b"hello")]
    decoded = audio.decode(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary"), 16000).cache()
    found = {r["file_id"]: r for r in prosody(decoded).collect()}
    assert set(found) == {"voice", "short", "silent"}
    heard = np.concatenate([np.asarray(r["samples"], np.float64) for r in decoded.where("path = 'voice'").orderBy("first").collect()])
    want = plain_prosody(heard)
    row = found["voice"]
    assert np.allclose([row["level_sd"], row["pitch_sd"], row["rate"], row["tilt"]], want, atol=1e-6)
    unit = [np.clip((v - a) / (b - a), 0, 1) for v, (a, b) in zip(want, ((3, 11), (0.8, 4), (0.15, 0.55), (-0.6, 0.4)))]
    assert abs(row["arousal"] - np.clip(2 * np.dot(unit, [0.3, 0.3, 0.2, 0.2]) - 1, -1, 1)) < 1e-6
    assert found["short"]["arousal"] == 0.0 and found["short"]["rate"] is None
    assert found["silent"]["level_sd"] == 0.0 and found["silent"]["arousal"] == -1.0 + 2 * 0.2 * 1.0
