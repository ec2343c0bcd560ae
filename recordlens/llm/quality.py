"""Quality by compression: zstandard dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, table

FOLDS, HELD_OUT = 5, 0
#: The fit uses at most this many labelled documents of each class, whole.
FIT_ROWS = 1500
DICTIONARY = 131072
#: Compression level and bytes of a block, cheapest first. ``fit`` takes the cheapest whose area under the curve, on
#: training rows that are in no dictionary, lies within NEAR_BEST of the best.
SETTINGS = ((3, 512), (3, 256), (9, 256), (9, 128))
NEAR_BEST = 0.005
THRESHOLD = 0.3


def _blocks(raw: bytes, block: int) -> list[bytes]:
    """The whole text in blocks, short enough that a dictionary matters in each."""
    count = max(1, ceil(len(raw) / block))
    size = ceil(len(raw) / count)
    return [raw[k : k + size] for k in range(0, len(raw), size)] if raw else []


@lru_cache(maxsize=8)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """One for each dictionary and level in each Python worker."""
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False, write_checksum=False)


class CompressionScorer:
    """Compressed sizes under two dictionaries, and the calibrated score of their difference."""

    def __init__(self, good: bytes, bad: bytes, weight: float = 0.0, offset: float = 0.0, level: int = SETTINGS[0][0], block: int = SETTINGS[0][1]) -> None:
        self.good, self.bad, self.weight, self.offset, self.level, self.block = good, bad, weight, offset, level, block

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(content, self.level) for content in (self.good, self.bad)]

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Of each text (size under the bad dictionary - size under the good one) / its bytes; empty texts have 0.

        Dividing by the text and not by the compressed sizes keeps text that repeats itself, which
        both dictionaries compress alike, near 0.
        """
        good, bad = self._compressors()
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            if blocks := _blocks(raw := (text or "").encode(), self.block):
                g, b = (sum(len(c.compress(block)) for block in blocks) for c in (good, bad))
                out[k] = (b - g) / len(raw)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), 1 / (1 + exp(-self.offset)))
        return _sigmoid(self.differences(texts) * self.weight + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and offset of a lightly penalised logistic fit of one feature by Newton's method."""
    middle, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(60):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] / spread * middle)


def area_under_curve(x: np.ndarray, y: np.ndarray) -> float:
    """How often a row of class 1 has the larger ``x`` than one of class 0; ties count half."""
    order = np.sort(x[y == 0])
    one = x[y == 1]
    if not len(order) or not len(one):
        return 0.5
    return float((np.searchsorted(order, one, side="left") + np.searchsorted(order, one, side="right")).mean() / (2 * len(order)))


def piece_length(sizes: list[int], whole: int = DICTIONARY) -> int:
    """How many bytes of each of some texts fit into ``whole`` if each gives as many, shorter ones all."""
    left = whole
    for k, size in enumerate(sorted(sizes)):
        part = left // (len(sizes) - k)
        if size > part:
            return part
        left -= size
    return max(sizes, default=0)


def fit(docs: DataFrame, labels: DataFrame) -> CompressionScorer:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    Of each class at most FIT_ROWS labelled documents are used, those of the least hash of doc_id;
    of rows that share a doc_id the greatest text counts. Every other one gives an equal piece,
    from a place anywhere in its text, to its class's dictionary of DICTIONARY bytes (a shorter text
    all of it). The rest, whole, choose among SETTINGS and calibrate the difference; they are compressed
    in tasks, and only pieces and differences come to the driver. With one class only, or without labels, every score
    is the smoothed share of label 1.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where((fold != HELD_OUT) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for q in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 2 * FIT_ROWS rows
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
        .withColumn("n", F.row_number().over(order))
    )
    sample = cut(sample.repartition(32, "doc_id"))
    books = sample.where("n % 2 = 1").withColumn("raw", F.encode("text", "utf-8"))
    sizes: dict[int, list[int]] = {0: [], 1: []}
    for r in books.select("quality", F.length("raw").alias("size")).collect():
        sizes[r["quality"]].append(r["size"])
    rest = sample.where("n % 2 = 0").select("quality", "text")
    held = {r["quality"]: r["count"] for r in sample.groupBy("quality").count().collect()}
    if min(held.get(0, 0), held.get(1, 0)) < 2:
        return CompressionScorer(b"", b"", offset=prior)
    part = F.when(F.col("quality") == 1, piece_length(sizes[1])).otherwise(piece_length(sizes[0]))
    start = (F.crc32("raw") % F.greatest(F.length("raw") - part + 1, F.lit(1))).cast("int") + 1
    pieces = books.select("quality", "n", F.substring("raw", start, part).alias("piece")).orderBy("n").collect()  # two dictionaries
    book = {q: b"".join(bytes(r["piece"]) for r in pieces if r["quality"] == q) or b" " * 8 for q in (0, 1)}
    tried = [CompressionScorer(book[1], book[0], level=level, block=block) for level, block in SETTINGS]

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            xs = np.column_stack([scorer.differences(texts) for scorer in tried])
            yield pa.record_batch([batch["quality"], pa.array(list(xs), pa.list_(pa.float64()))], ["quality", "x"])

    found = rest.mapInArrow(differences, "quality int, x array<double>").collect()  # at most FIT_ROWS rows of numbers
    y, xs = np.array([r["quality"] for r in found], float), np.array([r["x"] for r in found])
    areas = [area_under_curve(xs[:, k], y) for k in range(len(SETTINGS))]
    best = next(k for k, area in enumerate(areas) if area >= max(areas) - NEAR_BEST)
    scorer, order = tried[best], np.lexsort((y, xs[:, best]))  # a fixed order, so that sums are the same each time
    y = y[order]
    scorer.weight, offset = _logistic(xs[order, best], y)
    # the bound on rows balances the classes; the offset goes back to the labels' own share
    scorer.offset = offset + prior - log((sum(y) + 1) / (len(y) - sum(y) + 1))
    return scorer


def score(docs: DataFrame, scorer: CompressionScorer, *extra: str) -> DataFrame:
    """``(doc_id, score, *extra)`` for each row of docs: the calibrated score of the whole text.

    Labels, lang, source and doc_id are no inputs. Null texts count as empty, and empty texts get
    the calibrated score of no evidence; very long texts are compressed whole, block by block; rows
    come back as often as they came; an empty table gives no rows. A column of docs named ``score``
    is not returned, even if ``extra`` names it.
    """
    kept = ["doc_id", *(name for name in extra if name != "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scorer.scores(batch["text" if "text" in kept else "_text"].to_pylist()))
            yield pa.record_batch([*(batch[c] for c in kept), found], [*kept, "score"])

    source = docs.select(*kept) if "text" in kept else docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return source.mapInArrow(run, f"{schema}, score double")


def keep_good(docs: DataFrame, scorer: CompressionScorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose text's score reaches ``threshold``.

    Null texts count as empty, so the threshold decides on all of them alike; repeated rows stay or
    go together; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch["text"].to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
