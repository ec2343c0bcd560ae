"""What decoded rows of samples show, without a row for each sample or frame.

Rows are those of ``sources.audio.decode`` and ``sources.pcm.read_pcm``: an array of samples each,
with what follows beside it. Runs are a monoid: a row gives its inner runs, and the runs that
touch its borders; one window over a file's rows joins those that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.intervals import frame_range
from recordlens.shared import cut
from recordlens.sources.audio import NFFT, spectrum
from recordlens.sources.pcm import TAIL

# Step of the frames of noise, of those of bandwidth; seconds over which a floor is the minimum, and frames at least.
NOISE_HOP, BAND_HOP, MINIMUM_S, LEAST_WINDOW = 256, 512, 1.5, 3
# The band that noise is judged in, and the part of it below half the rate that counts; where shapes of floors begin and end.
NOISE_HZ, USABLE, FLOOR_HZ = (200.0, 7000.0), 0.95, (44.0, 3400.0)
# The band of speech, where the band above it begins and the highest frequency that counts.
SPEECH_HZ, ABOVE_HZ, TOP_HZ = (300.0, 3400.0), 3600.0, 7500.0
#: Rows for ``measured_rows`` have so many samples, and this many seconds beside them: a window of minima and a frame.
ROW_SAMPLES, TAIL_S = 1 << 18, 1.7
SAMPLES, FRAMES, BANDS = "samples", "frames", "bands"


# -- runs ----------------------------------------------------------------------------------------


def _edges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of a flag."""
    turns = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return turns[::2], turns[1::2]


def row_runs(x: np.ndarray, first: int, flag: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of one row: first and last place in the file, lowest and highest magnitude. Shorter ones than ``least`` only if they touch a border."""
    start, end = _edges(flag)
    kept = (end - start >= least) | (start == 0) | (end == len(x))
    start, end = start[kept], end[kept]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
    size = np.append(np.abs(x), 0)  # so that an end may be behind the last
    places = np.column_stack([start, end]).ravel()
    low, high = np.minimum.reduceat(size, places)[::2], np.maximum.reduceat(size, places)[::2]
    return start + first, end + first - 1, low.astype(np.float64), high.astype(np.float64)


def sample_runs(rows: DataFrame, limits: dict[str, tuple[Column, bool, int]]) -> DataFrame:
    """``(file_id, kind, first_i, last_i, n, low, high)``: runs of rows(path, first, samples, ...) by kind.

    ``limits`` gives for each kind a column of the rows, whether magnitudes must reach it (else lie
    below it), and the shortest run that is asked for. A null limit gives no runs. ``low`` and
    ``high`` are the run's least and greatest magnitude. Rows that overlap are not expected; empty
    and null arrays have no runs; a gap between rows ends a run.
    """
    kinds = list(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[str, str, tuple[np.ndarray, ...]]] = []
            for k in range(batch.num_rows):
                x = batch["samples"][k].values
                if x is None or not len(x):
                    continue
                x = x.to_numpy(zero_copy_only=False)
                path, first = batch["path"][k].as_py(), batch["first"][k].as_py()
                for kind in kinds:
                    limit = batch[f"limit_{kind}"][k].as_py()
                    if limit is not None:
                        size = np.abs(x)
                        flag = size >= x.dtype.type(limit) if limits_of[kind][0] else size < x.dtype.type(limit)
                        parts.append((path, kind, row_runs(x, first, flag, limits_of[kind][1])))
            n = [len(p[2][0]) for p in parts]
            columns = [pa.array([p[j] for p, m in zip(parts, n) for _ in range(m)], pa.string()) for j in (0, 1)]
            numbers = [np.concatenate([p[2][j] for p in parts] or [np.zeros(0)]) for j in range(4)]
            yield pa.record_batch([*columns, pa.array(numbers[0].astype(np.int64)), pa.array(numbers[1].astype(np.int64)), pa.array(numbers[2]), pa.array(numbers[3])], ["path", "kind", "first_i", "last_i", "low", "high"])

    limits_of = {kind: (above, least) for kind, (_, above, least) in limits.items()}
    asked = rows.select(F.col("path").cast("string").alias("path"), F.col("first").cast("long").alias("first"), "samples", *[limit.alias(f"limit_{kind}") for kind, (limit, _, _) in limits.items()])
    pieces = asked.mapInArrow(run, "path string, kind string, first_i long, last_i long, low double, high double")
    own = Window.partitionBy("path", "kind").orderBy("first_i")
    fresh = F.coalesce(F.lag("last_i").over(own) + 1 != F.col("first_i"), F.lit(True))
    island = F.sum(F.col("_new").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    joined = pieces.withColumn("_new", fresh).withColumn("_run", island).groupBy(F.col("path").alias("file_id"), "kind", "_run").agg(
        F.min("first_i").alias("first_i"), F.max("last_i").alias("last_i"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    least = F.create_map(*[F.lit(x) for kind, (_, _, shortest) in limits.items() for x in (kind, shortest)])
    counted = joined.withColumn("n", F.col("last_i") - F.col("first_i") + 1)
    return counted.where(F.col("n") >= F.try_element_at(least, F.col("kind"))).select("file_id", "kind", "first_i", "last_i", "n", "low", "high")


def peaks(rows: DataFrame) -> DataFrame:
    """``(file_id, peak)``: the greatest magnitude of each file, from arrays as they are."""
    own = F.greatest(F.array_max("samples"), -F.array_min("samples"))
    return rows.groupBy(F.col("path").alias("file_id")).agg(F.max(own).cast("double").alias("peak"))


# -- masks ---------------------------------------------------------------------------------------


def masks(regions: DataFrame, heads: DataFrame, row_samples: int = ROW_SAMPLES) -> DataFrame:
    """``(path, row, spans)``: regions(file_id, start_s, end_s) laid over the rows of heads(file_id, rate, length).

    Each region is masked by three conventions: samples from its first to before its last, both
    rounded down; frames of noise whose time lies in it, its end excluded; frames of bandwidth from
    the one it begins in up to the one it ends in. Spans are (kind, from, to) in units of the file.
    """
    timed = regions.join(heads, "file_id").where("end_s > start_s")
    rate, length, never = F.col("rate").cast("double"), F.col("length"), F.lit(1 << 62)
    noise_rate, hop = rate / NOISE_HOP, band_hop(length)
    kinds = (
        (SAMPLES, frame_range(F.col("start_s"), F.col("end_s"), rate, length, whole_end=True), F.lit(1)),
        (FRAMES, (F.ceil(F.col("start_s") * noise_rate).cast("long"), F.ceil(F.col("end_s") * noise_rate).cast("long")), F.lit(NOISE_HOP)),
        (BANDS, frame_range(F.col("start_s"), F.col("end_s"), rate / hop, never), hop),
    )
    spans = F.array(*[F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), (a * step).alias("from"), F.least(b * step, length).alias("to")) for kind, (a, b), step in kinds])
    each = timed.select("file_id", F.explode(spans).alias("s")).where((F.col("s.b") > F.col("s.a")) & (F.col("s.to") > F.col("s.from")))
    places = each.select("file_id", "s", F.explode(F.sequence(F.floor(F.col("s.from") / row_samples), F.floor((F.col("s.to") - 1) / row_samples))).alias("row"))
    return places.groupBy(F.col("file_id").alias("path"), "row").agg(F.collect_list(F.struct("s.kind", "s.a", "s.b")).alias("spans"))


def band_hop(length: Column) -> Column:
    """Step of the frames of bandwidth: half a spectrum; spectra of short files are shorter."""
    return F.when(length >= NFFT, BAND_HOP).when(length >= NFFT // 2, NFFT // 4).otherwise(NFFT // 8).cast("long")


def _masked(spans: list[dict] | None, kind: str, places: np.ndarray) -> np.ndarray:
    """Which of some ordered places a kind's spans cover."""
    inside = np.zeros(len(places) + 1, np.int64)
    for span in spans or ():
        if span["kind"] == kind:
            a, b = np.searchsorted(places, [span["a"], span["b"]])
            inside[a] += 1
            inside[b] -= 1
    return np.cumsum(inside[:-1]) > 0


# -- windows of speech and cuts ------------------------------------------------------------------


def _laid(spans: DataFrame, rate: int, row_samples: int, *keys: str) -> DataFrame:
    """spans(file_id, start_s, end_s, keys) in samples of decoded rows: (path, row, spans); both ends rounded down."""
    placed = spans.select("file_id", *keys, F.floor(F.col("start_s") * rate).cast("long").alias("a"), F.floor(F.col("end_s") * rate).cast("long").alias("b")).where("b > a and a >= 0")
    rows = placed.withColumn("row", F.explode(F.sequence(F.floor(F.col("a") / row_samples), F.floor((F.col("b") - 1) / row_samples))))
    return rows.groupBy(F.col("file_id").alias("path"), "row").agg(F.collect_list(F.struct(*keys, "a", "b")).alias("spans"))


# Seconds of a frame within a window, and its step.
FRAME_S, STEP_S = 0.020, 0.010


def window_levels(rows: DataFrame, spans: DataFrame, rate: int, row_samples: int) -> DataFrame:
    """``(file_id, cluster, win, rms, square, n)``: parts of spans(file_id, cluster, win, start_s, end_s) by the rows they lie in.

    ``rms`` are the levels of a window's frames that start in the row, ``square`` the sum of squares of
    its samples there and ``n`` their number. Rows were decoded at ``rate`` with ``row_samples``.
    """
    size, hop = int(FRAME_S * rate), int(STEP_S * rate)
    good = rows.where(F.col("error").isNull()).select("path", "first", "length", "samples", "tail", F.floor(F.col("first") / row_samples).alias("row"))
    held = good.join(_laid(spans, rate, row_samples, "cluster", "win"), ["path", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                path, first, length = (batch[c][k].as_py() for c in ("path", "first", "length"))
                own, tail = (batch[c][k].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in ("samples", "tail"))
                x = np.concatenate([own, tail])
                for span in batch["spans"][k].as_py():
                    a, b = span["a"], min(span["b"], length)
                    inside = own[max(a - first, 0) : max(b - first, 0)]
                    starts = np.arange(a + -(-max(0, first - a) // hop) * hop, min(b - size + 1, first + len(own)), hop) - first
                    frames = np.lib.stride_tricks.sliding_window_view(x, size)[starts] if len(starts) else np.zeros((0, size))
                    out.append((path, span["cluster"], span["win"], np.sqrt((frames**2).mean(axis=1)).tolist() if len(starts) else [], float((inside**2).sum()), len(inside)))
            yield pa.record_batch(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64()))],
                ["file_id", "cluster", "win", "rms", "square", "n"],
            )

    return held.select("path", "first", "length", "samples", "tail", "spans").mapInArrow(run, "file_id string, cluster int, win long, rms array<double>, square double, n long")


def cluster_levels(parts: DataFrame) -> DataFrame:
    """``(file_id, cluster, floor_db, level_sd)`` of ``window_levels``: the 10th percentile of a cluster's frames, and the deviation of its windows' levels."""
    db = lambda x: 20.0 * F.log10(F.greatest(x, F.lit(1e-10)))
    floors = parts.select("file_id", "cluster", F.explode("rms").alias("rms")).groupBy("file_id", "cluster").agg(db(F.percentile("rms", 0.1)).alias("floor_db"))
    levels = parts.groupBy("file_id", "cluster", "win").agg(F.sum("square").alias("square"), F.sum("n").alias("n")).where("n > 0")
    spread = levels.withColumn("db", db(F.sqrt(F.col("square") / F.col("n")))).groupBy("file_id", "cluster").agg(F.stddev_pop("db").alias("level_sd"))
    both = parts.select("file_id", "cluster").distinct().join(floors, ["file_id", "cluster"], "left").join(spread, ["file_id", "cluster"], "left")
    return both.select("file_id", "cluster", F.coalesce("floor_db", F.lit(0.0)).alias("floor_db"), F.coalesce("level_sd", F.lit(0.0)).alias("level_sd"))


def _union_length(spans: list[dict]) -> int:
    total, end = 0, -1
    for span in sorted(spans, key=lambda s: s["a"]):
        total += max(0, span["b"] - max(span["a"], end))
        end = max(end, span["b"])
    return total


def cut_to(rows: DataFrame, spans: DataFrame, rate: int, row_samples: int, tail: int = TAIL) -> DataFrame:
    """Rows of only those samples that spans(file_id, start_s, end_s) cover, one after another as if they were the file.

    Files without a covered sample keep all of theirs. Where each row's samples come to lie follows from
    the spans alone, so rows are cut in their own tasks, and the new rows put together from parts by
    place; no task sees a whole file.
    """
    lengths = rows.where(F.col("error").isNull()).select(F.col("path").alias("file_id"), "length").distinct()
    within = spans.join(lengths, "file_id").withColumn("end_s", F.least(F.col("end_s"), F.col("length") / rate))
    laid = _laid(within.select("file_id", "start_s", "end_s"), rate, row_samples)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for row, held in zip(batch["row"].to_pylist(), batch["spans"].to_pylist()):
                low, high = row * row_samples, (row + 1) * row_samples
                n.append(_union_length([{"a": max(s["a"], low), "b": min(s["b"], high)} for s in held]))
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n"])

    counted = laid.mapInArrow(count, "path string, row long, spans array<struct<a:bigint,b:bigint>>, n long")
    before = Window.partitionBy("path").orderBy("row")
    placed = counted.withColumns({
        "offset": F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("path")),
    }).where("n > 0")
    placed = cut(placed)
    good = rows.withColumn("row", F.floor(F.col("first") / row_samples)).where(F.col("error").isNull())
    held = good.join(placed, ["path", "row"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rate_, channels, first, at, total = (batch[c][k].as_py() for c in ("path", "rate", "channels", "first", "offset", "total"))
                own = batch["samples"][k].values.to_numpy(zero_copy_only=False)
                mask = np.zeros(len(own) + 1, np.int64)
                for span in batch["spans"][k].as_py():
                    mask[min(max(span["a"] - first, 0), len(own))] += 1
                    mask[min(max(span["b"] - first, 0), len(own))] -= 1
                x = own[np.cumsum(mask[:-1]) > 0].astype(np.float32)
                for new in range(max(0, (at - row_samples - tail) // row_samples), (at + len(x) - 1) // row_samples + 1):
                    low, high = max(at, new * row_samples), min(at + len(x), (new + 1) * row_samples + tail)
                    if low < high:
                        yield pa.record_batch(
                            [pa.array([path]), pa.array([rate_], pa.int32()), pa.array([channels], pa.int32()), pa.array([new * row_samples], pa.int64()), pa.array([total], pa.int64()), pa.array([low], pa.int64()), pa.array([x[low - at : high - at]], pa.list_(pa.float32()))],
                            ["path", "rate", "channels", "first", "length", "at", "x"],
                        )

    cuts = held.select("path", "rate", "channels", "first", "samples", "spans", "offset", "total").mapInArrow(parts, "path string, rate int, channels int, first long, length long, at long, x array<float>")
    whole = cuts.groupBy("path", "rate", "channels", "first", "length").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])).alias("x"))
    new = whole.select(
        "path", "rate", "channels", "first", "length", F.slice("x", 1, row_samples).alias("samples"), F.slice("x", row_samples + 1, tail).alias("tail"), F.lit(None).cast("string").alias("error")
    )
    untouched = rows.join(placed.select("path").distinct(), "path", "left_anti")
    return new.unionByName(untouched.select(*new.columns))


# -- levels, bands and floors --------------------------------------------------------------------


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima over ``width`` rows of (rows, columns), at each row that has so many from it on.

    Rows are taken in blocks of ``width``: a window is the end of one block and the beginning of the
    next, so running minima of blocks in both directions give all windows, whatever their width.
    """
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.concatenate([x, np.full((-n % width, x.shape[1]), np.inf)]).reshape(-1, width, x.shape[1])
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1, x.shape[1])
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1, x.shape[1])
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def minimum_runs(rows: DataFrame, width: int) -> DataFrame:
    """``(file_id, low, n)``: minima over ``width`` samples of rows(path, samples, tail), as runs of equal ones within a row.

    Each row gives the windows that start in it; where the file ends before a window does there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, counts = [], [], []
            for k in range(batch.num_rows):
                own, tail = (batch[c][k].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in ("samples", "tail"))
                lows = sliding_minimum(np.concatenate([own, tail])[:, None], width)[: len(own), 0]
                at = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]]) if len(lows) else np.zeros(0, int)
                names += [batch["path"][k].as_py()] * len(at)
                values.append(lows[at])
                counts.append(np.diff(np.append(at, len(lows))))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate([*values, np.zeros(0)])), pa.array(np.concatenate([*counts, np.zeros(0, int)]).astype(np.int64))], ["file_id", "low", "n"])

    return rows.select("path", "samples", "tail").mapInArrow(run, "file_id string, low double, n long")


def noise_window(rate: int, frames: int) -> int:
    """Frames over which a file's floor is the minimum: MINIMUM_S, or half of a shorter file."""
    width = max(LEAST_WINDOW, int(MINIMUM_S / (NOISE_HOP / rate)))
    return max(LEAST_WINDOW, frames // 2) if frames <= width else width


def _frame_count(length: int, size: int, hop: int) -> int:
    return max(0, (length - size) // hop + 1)


def row_spectra(x: np.ndarray, first: int, own: int, length: int, rate: int, size: int, hop: int, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the frames that start in a row and of ``more`` behind them, frequencies, and their powers."""
    begin, end = -(-first // hop), -(-(first + own) // hop)
    end = min(end + more, _frame_count(length, size, hop))
    numbers = np.arange(begin, max(begin, end))
    need = int(numbers[-1]) * hop + size - first if len(numbers) else 0
    if need > len(x):
        raise ValueError(f"a row needs {need} samples of its file from its first on and has {len(x)}: decode with a longer tail")
    hz, power = spectrum(x, rate, numbers * hop - first, size) if len(numbers) else (np.fft.rfftfreq(size, 1 / rate), np.zeros((0, size // 2 + 1)))
    return numbers, hz, power


def _row_noise(x: np.ndarray, first: int, own: int, length: int, rate: int, spans: list[dict] | None) -> dict:
    """Floors of the windows that start in a row, total power of its frames, and runs of equal minima by band."""
    frames = _frame_count(length, NFFT, NOISE_HOP)
    out: dict = {"floor": [], "power": [], "spoken": [], "band": [], "low": [], "n": []}
    if length < 4 * NFFT or frames < 8:
        return out
    width = noise_window(rate, frames)
    numbers, hz, power = row_spectra(x, first, own, length, rate, NFFT, NOISE_HOP, width - 1)
    starts = -(-(first + own) // NOISE_HOP) - -(-first // NOISE_HOP)
    inside = (hz >= NOISE_HZ[0]) & (hz <= min(NOISE_HZ[1], rate / 2 * USABLE))
    lows = sliding_minimum(power, width)[:starts]
    total = power[:starts, inside].sum(axis=1)
    out["floor"] = lows[:, inside].sum(axis=1)
    out["power"] = total
    out["spoken"] = total[_masked(spans, FRAMES, numbers[:starts])]
    if frames > max(LEAST_WINDOW, int(MINIMUM_S / (NOISE_HOP / rate))) and length >= 8 * NFFT and len(lows):
        kept = np.flatnonzero((hz >= FLOOR_HZ[0]) & (hz <= FLOOR_HZ[1]))
        by_band = lows[:, kept].T
        new = np.ones(by_band.shape, bool)
        new[:, 1:] = by_band[:, 1:] != by_band[:, :-1]
        at = np.flatnonzero(new.ravel())
        out["band"], out["low"], out["n"] = kept[at // by_band.shape[1]].astype(np.int32), by_band.ravel()[at], np.diff(np.append(at, by_band.size))
    return out


def _row_bands(x: np.ndarray, first: int, own: int, length: int, rate: int, spans: list[dict] | None) -> list[float]:
    """Power of speech, power above it and frames, of all frames that start in a row and of those in speech."""
    size = NFFT if length >= NFFT else NFFT // 2 if length >= NFFT // 2 else NFFT // 4
    hop = BAND_HOP if size > BAND_HOP else size // 2
    if length < size:
        return [0.0] * 6
    numbers, hz, power = row_spectra(x, first, own, length, rate, size, hop)
    speech = power[:, (hz >= SPEECH_HZ[0]) & (hz <= SPEECH_HZ[1])].sum(axis=1)
    above = power[:, (hz >= ABOVE_HZ) & (hz <= min(TOP_HZ, rate / 2 * USABLE))].sum(axis=1)
    spoken = _masked(spans, BANDS, numbers)
    return [float(speech.sum()), float(above.sum()), float(len(numbers)), float(speech[spoken].sum()), float(above[spoken].sum()), float(spoken.sum())]


_MEASURED = pa.schema([
    ("file_id", pa.string()), ("rate", pa.int32()), ("length", pa.int64()), ("n", pa.int64()), ("peak", pa.float64()), ("square", pa.float64()),
    ("spoken_n", pa.int64()), ("spoken_square", pa.float64()),
    *[(c, pa.float64()) for c in ("speech", "above", "frames", "spoken_speech", "spoken_above", "spoken_frames")],
    *[(c, pa.list_(pa.float64())) for c in ("floor", "power", "spoken")],
    ("band", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("times", pa.list_(pa.int64())),
])
MEASURED = (
    "file_id string, rate int, length long, n long, peak double, square double, spoken_n long, spoken_square double, speech double, above double, frames double, "
    "spoken_speech double, spoken_above double, spoken_frames double, floor array<double>, power array<double>, spoken array<double>, band array<int>, low array<double>, times array<long>"
)


def measured_rows(rows: DataFrame, spans: DataFrame | None = None, row_samples: int = ROW_SAMPLES) -> DataFrame:
    """One pass over decoded rows: their levels, bands of speech, and noise floors, each with and without the mask of speech.

    ``rows`` were decoded with ``row_samples`` and TAIL_S; ``spans`` are ``masks`` of the same rows. Frames
    stay arrays; equal minima of neighbouring windows are one value with a count. Rows with an error
    give none.
    """
    good = rows.where(F.col("error").isNull()).select("path", "rate", "first", "length", "samples", "tail", F.floor(F.col("first") / row_samples).alias("row"))
    held = good.withColumn("spans", F.lit(None).cast("array<struct<kind:string,a:bigint,b:bigint>>")) if spans is None else good.join(spans, ["path", "row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rate, first, length, marks = (batch[c][k].as_py() for c in ("path", "rate", "first", "length", "spans"))
                own, tail = (batch[c][k].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in ("samples", "tail"))
                whole = np.concatenate([own, tail])
                square = own * own
                spoken = _masked(marks, SAMPLES, np.arange(first, first + len(own))) if marks else np.zeros(len(own), bool)
                noise = _row_noise(whole, first, len(own), length, rate, marks)
                values = [
                    path, rate, length, len(own), float(np.abs(own).max(initial=0.0)), float(square.sum()), int(spoken.sum()), float(square[spoken].sum()),
                    *_row_bands(whole, first, len(own), length, rate, marks), *(noise[c] for c in ("floor", "power", "spoken", "band", "low", "n")),
                ]
                yield pa.record_batch([pa.array([v if not isinstance(v, np.ndarray) else v.tolist()], f.type) for v, f in zip(values, _MEASURED)], schema=_MEASURED)

    return held.select("path", "rate", "first", "length", "samples", "tail", "spans").mapInArrow(run, MEASURED)
