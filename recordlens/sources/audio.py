"""PCM WAV files: header, samples and spectral frames, decoded in tasks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.sources import pcm
from recordlens.sources.pcm import HEADER, PROBLEMS, RATE, PcmFile, resampled, resampled_length, told

# The length of a spectrum, and the range of voice pitch.
NFFT, PITCH_HZ, VOICED = 1024, (70.0, 320.0), 0.30


def read_header(content: bytes | None) -> tuple[int | None, int | None, int | None, str | None]:
    """Rate, channels, frames and an error of one file; what can't be read gives an error, never an exception."""
    try:
        with wave.open(io.BytesIO(content or b"")) as file:
            rate, channels, frames = file.getframerate() or RATE, file.getnchannels(), file.getnframes()
    except (wave.Error, EOFError, ValueError) as problem:
        return None, None, None, str(problem) or type(problem).__name__
    return rate, channels, frames, None if frames > 0 and rate > 0 else "no audio"


def readable(content: bytes | None) -> tuple[np.ndarray, int, str | None]:
    """Samples, rate and an error of one file: what can't be read gives an error, never an exception; one cut short its whole frames."""
    try:
        file = PcmFile(io.BytesIO(content or b""), len(content or b""))
        return file.read(0, file.frames), file.rate, None
    except PROBLEMS as problem:
        return np.zeros((0, 1), np.float32), 0, told(problem)


def probe(files: DataFrame) -> DataFrame:
    """Headers of files(path, content); a file that can't be read has an error and nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *read_header(content)) for path, content in zip(frame["path"], frame["content"])]
            out = pd.DataFrame(rows, columns=["path", "rate", "channels", "frames", "error"]).astype({c: "Int64" for c in ("rate", "channels", "frames")})
            out["duration_s"] = (out["frames"].astype("Float64") / out["rate"].astype("Float64")).astype("Float64")
            yield out[["path", "rate", "channels", "frames", "duration_s", "error"]]

    return files.select("path", "content").mapInPandas(run, HEADER)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """All samples at another rate."""
    return resampled(lambda first, count: x[first : first + count], len(x), rate, to, 0, resampled_length(len(x), rate, to))


def stereo_samples(files: DataFrame, limit_s: float = 60.0) -> DataFrame:
    """(file_id, left, right) of the first ``limit_s`` seconds of files with two channels or more: the probe for copied channels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                samples, rate, error = readable(content)
                if not error and samples.shape[1] >= 2:
                    probe = samples[: int(limit_s * rate)].astype(np.float64)
                    yield pd.DataFrame({"file_id": path, "left": probe[:, 0], "right": probe[:, 1]})

    return files.select("path", "content").mapInPandas(run, "file_id string, left double, right double")


def decode(files: DataFrame, rate: int | None = None, tail_s: float = 0.0, row_samples: int | None = None) -> DataFrame:
    """Mono samples of files(path, content), at their own rate or ``rate``, in rows of at most ROW_SAMPLES.

    Each row has at least ``tail_s`` seconds of what follows beside it. Unreadable files give one row
    with an error. ``pcm.read_pcm`` gives the same rows of files that no cell could hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    file = pcm.PcmFile(io.BytesIO(content or b""), len(content or b""))
                    yield from pcm.decoded_rows(path, file, rate, tail_s, row_samples or pcm.ROW_SAMPLES)
                except pcm.PROBLEMS as problem:
                    yield pcm.failed_row(path, problem)

    return files.select("path", "content").mapInArrow(run, pcm.SAMPLES)


def _framed(samples: np.ndarray, tail: np.ndarray, first: int, size: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's samples with its tail, the places in it where the frames of its own start, and their numbers in the file."""
    if size > pcm.TAIL + 1:
        raise ValueError(f"frames of {size} samples are longer than {pcm.TAIL + 1}")
    x = np.concatenate([np.asarray(samples, np.float64), np.asarray(tail, np.float64)])
    starts = np.arange(-first % hop, min(len(samples), len(x) - size + 1), hop)
    return x, starts, (first + starts) // hop


def frame_levels(decoded: DataFrame, size: int, hop: int) -> DataFrame:
    """Root mean square of each frame of ``size`` samples every ``hop``, over all of a file: (file_id, i, rms)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first, samples, tail in zip(frame["path"], frame["first"], frame["samples"], frame["tail"]):
                x, starts, at = _framed(samples, tail, int(first), size, hop)
                if len(starts):
                    windows = np.lib.stride_tricks.sliding_window_view(x, size)[starts]
                    yield pd.DataFrame({"file_id": path, "i": at, "rms": np.sqrt((windows**2).mean(axis=1))})

    return decoded.where(F.col("error").isNull()).select("path", "first", "samples", "tail").mapInPandas(run, "file_id string, i long, rms double")


def spectrum(x: np.ndarray, rate: int, starts: np.ndarray | slice, nfft: int = NFFT) -> tuple[np.ndarray, np.ndarray]:
    """Power by frequency of the Hann-windowed frames at ``starts``: (bins,), (frames, bins)."""
    if len(x) < nfft:
        return np.fft.rfftfreq(nfft, 1 / rate), np.zeros((0, nfft // 2 + 1))
    window = np.hanning(nfft + 1)[:-1]
    frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[starts] * window
    return np.fft.rfftfreq(nfft, 1 / rate), (np.abs(np.fft.rfft(frames, axis=1)) / window.sum()) ** 2


def mean_spectrum(decoded: DataFrame, hop: int = 512) -> DataFrame:
    """(file_id, rate, hz, power): mean power of each frequency over all of a file's frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rate, first, samples, tail in zip(frame["path"], frame["rate"], frame["first"], frame["samples"], frame["tail"]):
                x, starts, _ = _framed(samples, tail, int(first), NFFT, hop)
                hz, power = spectrum(x, int(rate), starts)
                if len(power):
                    yield pd.DataFrame({"file_id": path, "rate": int(rate), "hz": hz, "sum": power.sum(axis=0), "n": len(power)})

    parts = decoded.where(F.col("error").isNull()).select("path", "rate", "first", "samples", "tail").mapInPandas(run, "file_id string, rate int, hz double, sum double, n long")
    return parts.groupBy("file_id", "rate", "hz").agg((F.sum("sum") / F.sum("n")).alias("power"))


def modulation(levels: np.ndarray, frames_s: float) -> float:
    """Share of an envelope's spectrum that lies between 2 and 8 Hz: the rate of syllables; 0 below 32 frames."""
    moved = levels - levels.mean() if len(levels) >= 32 else np.zeros(0)
    if not moved.any():
        return 0.0
    size = np.abs(np.fft.rfft(moved * np.hanning(len(moved))))
    hz = np.fft.rfftfreq(len(moved), 1 / frames_s)
    return float(size[(hz >= 2) & (hz <= 8)].sum() / (size.sum() + 1e-12))


def voice_features(frames: np.ndarray, rate: int) -> pd.DataFrame:
    """rms, f0 (70 to 320 Hz, null where not periodic), and the spectrum's size from 100 Hz to 1 kHz and from there to 4 kHz, by frame."""
    size = frames.shape[1]
    level = frames - frames.mean(axis=1, keepdims=True)
    near, far = int(rate / 320), int(rate / 70)
    alike = np.fft.irfft(np.abs(np.fft.rfft(level, 2 * size, axis=1)) ** 2, axis=1)
    own, lags = alike[:, :1], alike[:, near:far]
    lags = np.divide(lags, own, out=np.zeros_like(lags), where=own > 1e-15)
    periodic = lags.max(axis=1, initial=0.0) > 0.30
    f0 = np.where(periodic, rate / (near + lags.argmax(axis=1)), np.nan)
    spectra, hz = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)), np.fft.rfftfreq(size, 1 / rate)
    low, high = (spectra[:, (hz >= a) & (hz < b)].sum(axis=1) for a, b in ((100, 1000), (1000, 4000)))
    return pd.DataFrame({"rms": np.sqrt((frames**2).mean(axis=1)), "f0": f0, "low": low, "high": high})


def voice_frames(decoded: DataFrame, size_s: float, hop_s: float) -> DataFrame:
    """(file_id, i, rms, f0, low, high): ``voice_features`` of each frame of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rate, first, samples, tail in zip(frame["path"], frame["rate"], frame["first"], frame["samples"], frame["tail"]):
                size = int(size_s * rate)
                x, starts, at = _framed(samples, tail, int(first), size, max(1, int(hop_s * rate)))
                if len(starts):
                    found = voice_features(np.lib.stride_tricks.sliding_window_view(x, size)[starts], int(rate))
                    found.insert(0, "i", at)
                    found.insert(0, "file_id", path)
                    yield found

    schema = "file_id string, i long, rms double, f0 double, low double, high double"
    found = decoded.where(F.col("error").isNull()).select("path", "rate", "first", "samples", "tail").mapInPandas(run, schema)
    return found.withColumn("f0", F.when(~F.isnan("f0"), F.col("f0")))


def mix_at_snr(speech: np.ndarray, noise: np.ndarray, snr_db: float, peak: float = 0.95) -> np.ndarray:
    """Speech with noise at an exact ratio, repeated or cut to its length, limited to ``peak``."""
    noise = np.resize(noise, len(speech)).astype(np.float64)
    power = lambda x: float(np.mean(np.square(x))) if len(x) else 0.0
    gain = np.sqrt(power(speech) / (power(noise) * 10 ** (snr_db / 10))) if power(noise) > 0 else 0.0
    mixed = speech + gain * noise
    top = np.abs(mixed).max(initial=0.0)
    return mixed * (peak / top) if top > peak else mixed
