"""PCM WAV files read by seeking: a data source whose partitions are ranges of files."""

from __future__ import annotations

import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Samples that a decoded row holds; longer files give several rows, each with the next TAIL samples
#: beside its own, so that a frame that starts in a row lies in it whole.
ROW_SAMPLES, TAIL = 1 << 16, 1 << 13
#: Bytes of files that one partition reads, about.
PARTITION_BYTES = 64 << 20
# Fixed value: the rate of a file whose header has none.
RATE = 48000
#: Half the length of the low-pass that goes before a change to a lower rate.
_TAPS = 64

HEADER = "path string, rate int, channels int, frames long, duration_s double, error string"
SAMPLES = "path string, rate int, channels int, first long, length long, samples array<float>, tail array<float>, error string"
_ROW = pa.schema([
    ("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("first", pa.int64()), ("length", pa.int64()),
    ("samples", pa.list_(pa.float32())), ("tail", pa.list_(pa.float32())), ("error", pa.string()),
])
_HEAD = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration_s", pa.float64()), ("error", pa.string())])
PROBLEMS = (wave.Error, EOFError, ValueError, KeyError, OSError)


def told(problem: Exception) -> str:
    return str(problem) or type(problem).__name__


class PcmFile:
    """An open file: its header, and any range of its samples. ``frames`` are the whole ones that are there."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file = file
        head = wave.open(file)  # noqa: SIM115  it stays open as long as its rows are read
        self.start = file.tell()
        self.rate, self.channels, self.width, self.stated = head.getframerate() or RATE, head.getnchannels(), head.getsampwidth(), head.getnframes()
        if self.width not in (1, 2, 3, 4):
            raise wave.Error(f"sample width {self.width}")
        self.frame_bytes = self.width * self.channels
        self.frames = min(self.stated, max(0, size - self.start) // self.frame_bytes)
        if self.frames <= 0 or self.rate <= 0:
            raise wave.Error("no audio")

    def read(self, first: int, count: int) -> np.ndarray:
        """Samples in -1..1 as (frames, channels); what lies outside of the file is left out."""
        first, end = max(0, first), min(self.frames, first + count)
        if end <= first:
            return np.zeros((0, self.channels), np.float32)
        self.file.seek(self.start + first * self.frame_bytes)
        raw = self.file.read((end - first) * self.frame_bytes)
        if self.width == 3:
            bytes3 = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            whole = (bytes3[:, 0] << 8 | bytes3[:, 1] << 16 | bytes3[:, 2] << 24) >> 8
        else:
            whole = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[self.width]).astype(np.int64) - (128 if self.width == 1 else 0)
        return (whole / float(1 << 8 * self.width - 1)).astype(np.float32).reshape(-1, self.channels)

    def mono(self, first: int, count: int) -> np.ndarray:
        return self.read(first, count).mean(axis=1)


def resampled_length(length: int, rate: int, to: int) -> int:
    return length if rate == to else int(length * to / rate)


def resampled(read: Callable[[int, int], np.ndarray], length: int, rate: int, to: int, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first`` on at rate ``to``: a windowed-sinc low-pass at the lower Nyquist frequency, then interpolation.

    ``read(first, count)`` gives samples at the file's own rate; only those that matter are asked for.
    """
    count = max(0, min(count, resampled_length(length, rate, to) - first))
    if rate == to or not count:
        return read(first, count).astype(np.float32)
    places = np.arange(first, first + count) * rate / to
    low, high = int(places[0]), min(length, int(places[-1]) + 2)
    if to < rate and length > 2 * _TAPS + 1:
        cutoff = 0.5 * to / rate * 0.95
        taps = np.arange(-_TAPS, _TAPS + 1)
        kernel = 2 * cutoff * np.sinc(2 * cutoff * taps) * np.hamming(len(taps))
        begin, end = max(0, low - _TAPS), min(length, high + _TAPS)
        x = np.pad(read(begin, end - begin), (_TAPS - (low - begin), _TAPS - (end - high)))
        smooth = np.convolve(x, kernel / kernel.sum(), mode="valid")
    else:
        smooth = read(low, high - low)
    return np.interp(places, np.arange(low, high), smooth).astype(np.float32)


def row_batch(path: str, rate: int, channels: int, first: int, length: int, samples: np.ndarray, tail: np.ndarray, error: str | None = None) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([path]), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([first], pa.int64()), pa.array([length], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples)), pa.ListArray.from_arrays(pa.array([0, len(tail)], pa.int32()), pa.array(tail)), pa.array([error], pa.string())],
        schema=_ROW,
    )


def decoded_rows(path: str, file: PcmFile, to: int | None, tail_s: float, row_samples: int, begin: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a file whose first sample lies in bytes ``begin`` to ``end`` of its samples."""
    rate = to or file.rate
    length = resampled_length(file.frames, file.rate, rate)
    tail = max(TAIL, int(np.ceil(tail_s * rate)))
    for first in range(0, length, row_samples):
        at = first * file.rate // rate * file.frame_bytes
        if at < begin:
            continue
        if end is not None and at >= end:
            return
        x = resampled(file.mono, file.frames, file.rate, rate, first, row_samples + tail)
        yield row_batch(path, rate, file.channels, first, length, x[:row_samples], x[row_samples:])


def failed_row(path: str, problem: Exception) -> pa.RecordBatch:
    none = np.zeros(0, np.float32)
    return row_batch(path, 0, 0, 0, 0, none, none, told(problem))


@dataclass
class Ranges(InputPartition):
    """Ranges of files that one task reads: path, first byte, the byte after it (None is the end), size."""

    parts: list[tuple[str, int, int | None, int]]


def planned(sizes: list[tuple[str, int]], partition_bytes: int) -> list[Ranges]:
    """Files in order of path, long ones cut into ranges, short ones together, about ``partition_bytes`` a partition."""
    out: list[list[tuple[str, int, int | None, int]]] = [[]]
    held = 0
    for path, size in sorted(sizes):
        for begin in range(0, max(size, 1), partition_bytes):
            last = begin + partition_bytes >= size
            part = min(partition_bytes, size - begin)
            if out[-1] and held + part > partition_bytes:
                out.append([])
                held = 0
            out[-1].append((path, begin, None if last else begin + partition_bytes, size))
            held += part
    return [Ranges(parts) for parts in out if parts]


def opened(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


def reachable(place: str) -> bool:
    """Whether Python's file systems reach a place; other stores are read by Spark, files as whole cells."""
    try:
        system, path = opened(place)
        return system.get_file_info(path).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False


class PcmReader(DataSourceReader):
    """Plans from the listing alone; headers are read in tasks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.rate = int(options["rate"]) if options.get("rate") else None
        self.tail_s = float(options.get("tail_s", 0.0))
        self.row_samples = int(options.get("row_samples", ROW_SAMPLES))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.headers = options.get("only", "") == "headers"
        self.suffixes = tuple(f".{x.lower()}" for x in options.get("suffixes", "wav,wave").split(","))

    def partitions(self) -> list[Ranges]:
        system, root = opened(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffixes)]
        return planned(sizes, self.partition_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        for path, begin, end, size in partition.parts:
            if self.headers:
                if begin == 0:
                    with system.open_input_file(path) as raw:
                        yield header_batch(path, raw, size)
                continue
            try:
                with system.open_input_file(path) as raw:
                    yield from decoded_rows(path, PcmFile(raw, size), self.rate, self.tail_s, self.row_samples, begin, end)
            except PROBLEMS as problem:
                if begin == 0:
                    yield failed_row(path, problem)


def header_batch(path: str, file: BinaryIO, size: int) -> pa.RecordBatch:
    try:
        head = PcmFile(file, size)
        row = [path, head.rate, head.channels, head.stated, head.stated / head.rate, None]
    except PROBLEMS as problem:
        row = [path, None, None, None, None, told(problem)]
    return pa.record_batch([pa.array([value], field.type) for value, field in zip(row, _HEAD)], schema=_HEAD)


class PcmWav(DataSource):
    """``spark.read.format("pcm_wav")``: decoded rows of the WAV files below a folder.

    Options: ``rate`` to resample to, ``tail_s`` seconds beside each row at least, ``row_samples``,
    ``partition_bytes``, ``suffixes`` of the files, and ``only=headers`` for the headers alone. A file may be of any size: its
    ranges are read by different tasks, each seeking to its own. Paths are those of pyarrow's file
    systems (local, object stores, HDFS); what can't be read has a row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_wav"

    def schema(self) -> str:
        return HEADER if self.options.get("only") == "headers" else SAMPLES

    def reader(self, schema) -> PcmReader:  # noqa: ANN001
        return PcmReader(dict(self.options))


def read_pcm(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(PcmWav)
    return spark.read.format("pcm_wav").options(**{k: str(v) for k, v in options.items() if v is not None}).load(folder)
