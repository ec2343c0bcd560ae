"""What rows of samples show, against one pass of numpy over whole files."""

import io
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from recordlens.operators import samples
from recordlens.plans import impairment, noise
from recordlens.sources import audio, pcm


def wav(x, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def runs_of(flag):
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def decoded(spark, files, **more):
    return audio.decode(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary"), **more)


# -- plain versions: one file, all of its samples --------------------------------------------------


def ramp(x, low, high):
    return float(np.clip((x - low) / (high - low), 0, 1))


def plain_impairments(x, rate, speech):
    x = np.asarray(x, np.float32)
    size, peak = np.abs(x), float(np.abs(x).max())
    flat = [b - a for a, b in runs_of(size >= 0.985 * peak) if b - a >= 3 and size[a:b].max() - size[a:b].min() <= 0.002 * peak] if peak > 0 else []
    clipping = max(ramp(sum(flat) / len(x), 0.0005, 0.04), ramp(max(flat), 8, 100)) if flat else 0.0
    mask = np.zeros(len(x), bool)
    for a, b in speech:
        mask[int(a * rate) : min(len(x), int(b * rate))] = True
    level = float(np.sqrt(np.mean((x[mask] if mask.any() else x).astype(float) ** 2)))
    dropouts = 0.0
    if speech:
        floor = max(1e-6, level * 10 ** (-55 / 20))
        lengths = max(1, int(0.004 * rate)), int(0.25 * rate)
        held = sum(1 for a, b in runs_of(size < floor) if lengths[0] <= b - a <= lengths[1] and any(s <= (a + b) / 2 / rate <= e for s, e in speech))
        dropouts = ramp(held / (sum(b - a for a, b in speech) or 1.0), 0.3, 5.0)
    db = 20 * np.log10(max(level, 1e-9))
    nfft = max(256, min(1024, 1 << int(np.log2(max(len(x), 256)))))
    hop = 512 if nfft > 512 else nfft // 2
    window = np.hanning(nfft + 1)[:-1]
    n = (len(x) - nfft) // hop + 1
    frames = np.stack([x[k * hop : k * hop + nfft] for k in range(n)]) * window
    power = np.abs(np.fft.rfft(frames, axis=1) / window.sum()) ** 2
    voiced = np.zeros(n, bool)
    for a, b in speech:
        voiced[int(a / (hop / rate)) : min(n, int(np.ceil(b / (hop / rate))))] = True
    mean = power[voiced if voiced.any() else slice(None)].mean(axis=0)
    hz = np.fft.rfftfreq(nfft, 1 / rate)
    low, top = mean[(hz >= 300) & (hz <= 3400)].sum(), min(7500, rate / 2 * 0.95)
    narrow = ramp(-rate, -16000, -7900) * 0.55
    if top > 4200 and low > 0:
        narrow = max(narrow, ramp(-10 * np.log10((mean[(hz >= 3600) & (hz <= top)].sum() + 1e-20) / (low + 1e-20)), 32, 48))
    loud = max(ramp(-db, 42, 60), ramp(db, -6, -1.5))
    whole = 1 - (1 - clipping) * (1 - 0.9 * dropouts) * (1 - 0.6 * loud) * (1 - 0.55 * narrow)
    return clipping, dropouts, loud, narrow, whole


def plain_floor(x, rate):
    window = np.hanning(1025)[:-1]
    n = max(0, (len(x) - 1024) // 256 + 1)
    power = np.abs(np.fft.rfft(np.stack([x[k * 256 : k * 256 + 1024] for k in range(n)]) * window, axis=1) / window.sum()) ** 2 if n else np.zeros((0, 513))
    return np.fft.rfftfreq(1024, 1 / rate), power, max(3, int(1.5 / (256 / rate)))


def plain_noise(x, rate, speech):
    x = np.asarray(x, np.float32).astype(float)
    hz, power, width = plain_floor(x, rate)
    if len(x) < 4096 or len(power) < 8:
        return -90.0
    band = power[:, (hz >= 200) & (hz <= min(7000, rate / 2 * 0.95))]
    if len(band) <= width:
        width = max(3, len(band) // 2)
    floor = np.array([band[k : k + width].min(axis=0).sum() for k in range(len(band) - width + 1)]) * 1.5
    t = np.arange(len(band)) * 256 / rate
    mask = np.zeros(len(band), bool)
    for a, b in speech:
        mask |= (t >= a) & (t < b)
    spoken = band.sum(axis=1)[mask] if mask.any() else band.sum(axis=1)
    return float(np.clip(10 * np.log10(np.percentile(floor, 90) + 1e-30) - 10 * np.log10(np.percentile(spoken, 50) + 1e-30), -90, 0))


def plain_spectrum(x, rate):
    hz, power, width = plain_floor(np.asarray(x, np.float32).astype(float), rate)
    if len(x) < 8192 or len(power) <= width:
        return None
    return hz, np.median(np.stack([power[k : k + width].min(axis=0) for k in range(len(power) - width + 1)]), axis=0)


# -- runs --------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.5, 0.9, -0.9]), max_size=40), st.integers(1, 4))
def test_row_runs(x, least):
    x = np.array(x)
    first, last, low, high = samples.row_runs(x, 100, np.abs(x) >= 0.9, least)
    want = [(a + 100, b + 99) for a, b in runs_of(np.abs(x) >= 0.9) if b - a >= least or a == 0 or b == len(x)]
    assert list(zip(first.tolist(), last.tolist())) == want and (low >= 0.9).all() and (high >= low).all()


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_runs_over_row_borders(spark, size):
    rng = np.random.default_rng(size)
    files = {name: rng.choice([0.01, 0.2, 0.95, 1.0, -0.97], 300, p=p).astype(np.float32) for name, p in (("a", [0.1, 0.1, 0.4, 0.3, 0.1]), ("b", [0.6, 0.1, 0.1, 0.1, 0.1]))}
    files["flat"] = np.ones(50, np.float32)
    rows = [(n, k, x[k : k + size].tolist()) for n, x in files.items() for k in range(0, len(x), size)] + [("none", 0, None), ("empty", 0, [])]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "path string, first long, samples array<float>").repartition(4)
    limits = {"clipped": (F.when(F.col("path") != "c", F.lit(0.9)), True, 3), "quiet": (F.lit(0.1), False, 2), "off": (F.lit(None).cast("double"), True, 1)}
    found = {(r["file_id"], r["kind"], r["first_i"], r["last_i"], r["n"], round(r["low"], 3), round(r["high"], 3)) for r in samples.sample_runs(frame, limits).collect()}
    want = set()
    for n, x in files.items():
        for kind, flag, least in (("clipped", np.abs(x) >= np.float32(0.9), 3), ("quiet", np.abs(x) < np.float32(0.1), 2)):
            for a, b in runs_of(flag):
                if b - a >= least:
                    want.add((n, kind, a, b - 1, b - a, round(float(np.abs(x[a:b]).min()), 3), round(float(np.abs(x[a:b]).max()), 3)))
    assert found == want and len(want) > 20
    assert {r["file_id"]: round(r["peak"], 3) for r in samples.peaks(frame).collect() if r["peak"] is not None} == {n: 1.0 for n in files}


def test_no_row_a_sample(spark):
    """The plan of the runs has no Generate: samples stay arrays."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 0, [1.0])], "path string, first long, samples array<float>")
    plan = samples.sample_runs(rows, {"x": (F.lit(0.5), True, 1)})._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(1, 12))
def test_sliding_minimum(rows, width):
    x = np.random.default_rng(rows * 13 + width).integers(0, 9, (rows, 3)).astype(float)
    want = [x[k : k + width].min(axis=0) for k in range(rows - width + 1)]
    found = samples.sliding_minimum(x, width)
    assert len(found) == len(want) and all((a == b).all() for a, b in zip(found, want))


# -- whole files at their own rate -------------------------------------------------------------------


def recordings():
    rng = np.random.default_rng(11)
    out = []
    for rate, seconds in ((8000, 5.0), (16000, 9.3), (48000, 7.1), (16000, 0.9), (8000, 0.2), (16000, 0.03), (22050, 2.0)):
        t = np.arange(int(rate * seconds)) / rate
        x = 0.3 * np.sin(2 * np.pi * 220 * t) * (np.sin(2 * np.pi * 0.7 * t) > -0.3) + 0.004 * rng.standard_normal(len(t))
        if seconds > 4:
            for at in rng.uniform(0.2, seconds - 0.5, 12):  # holes of some 20 ms
                x[int(at * rate) : int((at + rng.uniform(0.002, 0.04)) * rate)] = 0.0
        if rate == 16000:
            x = np.clip(x * 4, -0.8, 0.8)
        regions = [(0.1, seconds * 0.4), (seconds * 0.5, seconds * 0.93)] if seconds > 0.1 else []
        out.append((f"{rate}-{seconds}", rate, x, regions))
    out.append(("silent", 16000, np.zeros(40_000), [(0.5, 1.5)]))
    out.append(("mute", 16000, 0.1 * rng.standard_normal(30_000), []))
    return out


@pytest.fixture(scope="module")
def measured(spark, tmp_path_factory):
    made = recordings()
    folder = tmp_path_factory.mktemp("calls")
    for name, rate, x, _ in made:
        (folder / f"{name}.wav").write_bytes(wav(x, rate))
    (folder / "bad.wav").write_bytes(b"no audio")
    size = 1 << 14  # several rows a file
    rows = pcm.read_pcm(spark, str(folder), tail_s=samples.TAIL_S, row_samples=size, partition_bytes=100_000).cache()
    heads = pcm.read_pcm(spark, str(folder), only="headers").where("error is null").selectExpr("path as file_id", "rate", "frames as length")
    regions = spark.createDataFrame([(f"{folder}/{n}.wav", a, b) for n, _, _, speech in made for a, b in speech], "file_id string, start_s double, end_s double")
    found = samples.measured_rows(rows, samples.masks(regions, heads, size), size).cache()
    return made, folder, rows, regions, found


def quantised(x):
    return ((np.clip(x, -1, 1) * 32767).astype("<i2") / 32768.0).astype(np.float32)


def test_impairments_are_those_of_one_pass(measured):
    made, folder, rows, regions, found = measured
    scores = {r["file_id"]: r for r in impairment.impairments(found, rows, regions).collect()}
    assert set(scores) == {f"{folder}/{n}.wav" for n, *_ in made}
    some = 0
    for name, rate, x, speech in made:
        row = scores[f"{folder}/{name}.wav"]
        want = plain_impairments(quantised(x), rate, speech)
        assert np.allclose([row[c] for c in ("clipping", "dropouts", "level", "bandwidth", "degradation_score")], want, atol=1e-3), (name, row, want)
        some += (want[0] > 0) + (want[1] > 0)
    assert some >= 4
    alone = {r["file_id"]: r for r in impairment.impairments(samples.measured_rows(rows, None, 1 << 14), rows).collect()}
    name, rate, x, _ = made[1]
    assert abs(alone[f"{folder}/{name}.wav"]["degradation_score"] - plain_impairments(quantised(x), rate, [])[4]) < 1e-3


def test_noise_at_the_files_own_rate(measured):
    made, folder, _, _, found = measured
    levels = {r["file_id"]: r["noise_level_db"] for r in noise.noise_level(found).collect()}
    spectra = {}
    for r in noise.floor_spectrum(found).collect():
        spectra.setdefault(r["file_id"], {})[r["hz"]] = r["power"]
    for name, rate, x, speech in made:
        path = f"{folder}/{name}.wav"
        assert abs(levels[path] - plain_noise(quantised(x), rate, speech)) < 1e-3, name
        want = plain_spectrum(quantised(x), rate)
        assert (path in spectra) == (want is not None), name
        if want:
            hz, power = want
            kept = (hz >= 44) & (hz <= 3400)
            assert np.allclose([spectra[path][h] for h in hz[kept]], power[kept], rtol=1e-6, atol=1e-18), name


def test_noise_terms_by_shape(spark):
    """White noise is static, a mains tone hum, noise below 300 Hz road noise; a short recording has no term."""
    rng = np.random.default_rng(4)
    files = []
    for rate in (16000, 44100):
        t = np.arange(5 * rate) / rate
        white = 0.1 * rng.standard_normal(len(t))
        spectrum = np.fft.rfft(white)
        spectrum[np.fft.rfftfreq(len(t), 1 / rate) > 300] *= 0.001
        files += [(f"static{rate}", wav(white, rate)), (f"road{rate}", wav(np.fft.irfft(spectrum), rate)), (f"hum{rate}", wav(0.3 * np.sin(2 * np.pi * 180 * t) + 0.3 * np.sin(2 * np.pi * 120 * t), rate)), (f"short{rate}", wav(white[:rate], rate))]
    found = samples.measured_rows(decoded(spark, files, tail_s=samples.TAIL_S, row_samples=samples.ROW_SAMPLES)).cache()
    terms = {r["file_id"]: r["noise_class_dist"] for r in noise.noise_terms(found).collect()}
    for rate in (16000, 44100):
        assert terms[f"static{rate}"] == {"static": 1.0} and "road noise" in terms[f"road{rate}"] and f"short{rate}" not in terms
    votes = spark.createDataFrame([("static16000", "music", 0.8), ("short16000", "music", 0.2)], "file_id string, term string, score double")
    both = {r["file_id"]: r["noise_class_dist"] for r in noise.noise(found, votes).collect()}
    assert both["short16000"] == {"music": 1.0} and 0.6 < both["static16000"]["music"] < 0.8 and abs(sum(both["static16000"].values()) - 1) < 1e-3


def test_short_tail_is_refused(spark):
    rows = decoded(spark, [("a", wav(np.zeros(300_000), 16000))], row_samples=1 << 14)
    with pytest.raises(Exception, match="longer tail"):
        samples.measured_rows(rows, None, 1 << 14).collect()


# -- reading by ranges -------------------------------------------------------------------------------


@pytest.mark.parametrize("rate", [None, 16000, 8000])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, rate, monkeypatch):
    rng = np.random.default_rng(5)
    (tmp_path / "deep").mkdir()
    stereo = np.stack([0.2 * rng.standard_normal(90_001), 0.1 * rng.standard_normal(90_001)], 1)
    whole = {"long.wav": wav(0.2 * rng.standard_normal(400_003), 22050), "deep/two.WAV": wav(stereo, 8000, 2), "one.wav": wav(np.ones(1) * 0.5, 8000), "cut.wav": wav(0.1 * rng.standard_normal(70_000), 16000)[:-3]}
    whole |= {"text.wav": b"hello", "none.wav": b"", "head.wav": whole["one.wav"][:44]}
    for name, content in whole.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "note.txt").write_text("x")
    files = spark.createDataFrame([(f"{tmp_path}/{n}", bytearray(c)) for n, c in whole.items()], "path string, content binary")
    key = lambda r: (r["path"], r["first"])
    want = sorted(audio.decode(files, rate).collect(), key=key)
    planned = pcm.PcmReader({"path": str(tmp_path), "partition_bytes": "100000"}).partitions()
    assert len(planned) > 9 and max(sum(1 for p in part.parts) for part in planned) < 7
    found = sorted(pcm.read_pcm(spark, str(tmp_path), rate=rate, partition_bytes=100_000).collect(), key=key)
    assert [key(r) for r in found] == [key(r) for r in want] and len(found) > 9
    for a, b in zip(found, want):
        assert (a["rate"], a["channels"], a["length"], bool(a["error"])) == (b["rate"], b["channels"], b["length"], bool(b["error"]))
        assert a["samples"] == b["samples"] and a["tail"] == b["tail"]
    long = np.concatenate([r["samples"] for r in found if r["path"].endswith("long.wav")])
    x = pcm.PcmFile(io.BytesIO(whole["long.wav"]), len(whole["long.wav"])).mono(0, 1 << 30)
    assert np.allclose(long, audio.resample(x, 22050, rate or 22050), atol=1e-6)
    heads = {r["path"].rpartition("/")[2]: r for r in pcm.read_pcm(spark, str(tmp_path), only="headers", partition_bytes=100_000).collect()}
    assert set(heads) == {n.rpartition("/")[2] for n in whole} and heads["two.WAV"]["channels"] == 2 and heads["long.wav"]["frames"] == 400_003 and heads["text.wav"]["error"]
    assert pcm.read_pcm(spark, str(tmp_path / "one.wav")).count() == 1


def test_resampling_in_parts_is_resampling_at_once():
    x = np.random.default_rng(1).standard_normal(5000).astype(np.float32)
    read = lambda first, count: x[max(0, first) : first + count]
    for rate, to in ((22050, 16000), (8000, 16000), (48000, 16000), (16000, 16000)):
        n = pcm.resampled_length(len(x), rate, to)
        whole = pcm.resampled(read, len(x), rate, to, 0, n)
        parts = np.concatenate([pcm.resampled(read, len(x), rate, to, k, 700) for k in range(0, n, 700)])
        assert len(whole) == n and np.allclose(whole, parts, atol=1e-6)
