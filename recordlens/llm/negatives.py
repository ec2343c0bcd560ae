"""Hard negatives by a two-dimensional block matrix multiply (SUMMA).

The matrix of scores is anchors x rows. Anchors are sharded into panels i, rows into panels j, and
one task owns each block (i, j): it holds the anchors, streams the rows in tiles, and multiplies
the two chunk by chunk of the dimensions, adding the partial tiles of 64-bit integers up in place.
Scores never leave their task; of each block only the best of each window of an anchor do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, table, written

#: Anchors and rows of a tile, and dimensions of a chunk.
ANCHORS, ROWS, CHUNK = 256, 1024, 32
#: Components of a panel of anchors (32,768 anchors of 64), rows of a panel of rows at least, and panels of rows that a panel of anchors meets at most.
PANEL_CELLS, PANEL_ROWS, PANELS = 2**21, 4096, 24
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
ANCHOR_STEP = 50
SEED = 29
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FOUND = "at long, anchor long, row long, id long, score long, window int"


def partial_tile(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The products of two integer matrices' rows, by floating point, which is exact below 2**53."""
    if not left.shape[1]:
        return np.zeros((len(left), len(right)), np.int64)
    left, right = left.astype(np.float64), right.astype(np.float64)
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] >= 2**53:
        raise ValueError("components are too large for exact scores")
    return np.rint(left @ right.T).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Pieces of sorted rows with equal values of ``names``, and those values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


class Block:
    """Scores of a panel of anchors: the best rows so far of each window of each anchor.

    Rows come in the order of id, nulls last, then row, so of equal scores the earlier one stays.
    An anchor's ``extra`` is its label and its positives' scores, as many as it has; without ``within``
    (hundredths of a positive's score) it has one window, all other rows.
    """

    def __init__(self, anchors: pa.Table, count: int, within: tuple[int, int] | None, tile: tuple[int, int, int]) -> None:
        self.tile, self.near = tile, within is None
        self.at, self.id = anchors["row"].to_numpy(), anchors["id"].to_numpy()
        self.q = _matrix(anchors["q"], len(anchors))
        extra = _matrix(anchors["extra"], len(anchors))
        self.label = extra[:, 0]
        if within is None:
            self.low, self.high = np.full((len(anchors), 1), _NONE + 1), np.full((len(anchors), 1), _MOST)
        else:
            known = extra[:, 1:] != _NONE
            positive = np.where(known, extra[:, 1:], 0)
            self.low = np.where(known, -(-within[0] * positive // 100), _MOST)  # rounded up
            self.high = np.where(known, within[1] * positive // 100, _NONE)
        shape = (*self.low.shape, count)
        self.score, self.row, self.other = np.full(shape, _NONE), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.lacks = np.zeros(shape, bool)

    def take(self, rows: pa.RecordBatch) -> None:
        """Meets further rows, a tile at a time."""
        right, row, label = _matrix(rows["q"], rows.num_rows), rows["row"].to_numpy(), rows["label"].to_numpy()
        lacks = rows["id"].is_null().to_numpy(zero_copy_only=False)
        other = rows["id"].fill_null(0).to_numpy()
        size, _, chunk = self.tile
        for a in range(0, len(self.at), size):
            part = slice(a, a + size)
            scores = np.zeros((len(self.at[part]), len(row)), np.int64)
            for k in range(0, right.shape[1], chunk):
                scores += partial_tile(self.q[part, k : k + chunk], right[:, k : k + chunk])
            if np.abs(scores).max(initial=0) >= 2**56:
                raise ValueError("scores are too large")
            allowed = self.at[part, None] != row if self.near else self.label[part, None] != label
            self._keep(a, np.where(allowed, scores, _NONE), row, other, lacks)

    def _keep(self, a: int, scores: np.ndarray, row: np.ndarray, other: np.ndarray, lacks: np.ndarray) -> None:
        part, count = slice(a, a + len(scores)), self.score.shape[2]
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[part, w], self.score[part, w, -1] + 1)
            fits = (scores >= least[:, None]) & (scores <= self.high[part, w, None])
            hit = np.flatnonzero(fits.any(axis=1))
            if not len(hit):
                continue
            left, lines = np.where(fits[hit], scores[hit], _NONE), np.arange(len(hit))
            column = np.zeros((len(hit), min(count, len(row))), np.int64)
            value = np.full(column.shape, _NONE)
            for k in range(column.shape[1]):
                column[:, k] = left.argmax(axis=1)
                value[:, k] = left[lines, column[:, k]]  # _NONE where no more are left
                left[lines, column[:, k]] = _NONE
            place = a + hit
            order = np.argsort(~np.concatenate([self.score[place, w], value], axis=1), axis=1, kind="stable")[:, :count]
            for held, new in ((self.score, value), (self.row, row[column]), (self.other, other[column]), (self.lacks, lacks[column])):
                held[place, w] = np.take_along_axis(np.concatenate([held[place, w], new], axis=1), order, axis=1)

    def found(self, size: int = 4096) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.at), size):
            place, window, k = np.nonzero(self.score[a : a + size] != _NONE)
            place += a
            pick = lambda values: values[place, window, k]  # noqa: E731, B023
            columns = [self.at[place], self.id[place], pick(self.row), pa.array(pick(self.other), mask=pick(self.lacks)), pick(self.score), (window + 1).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], ["at", "anchor", "row", "id", "score", "window"])


def _search(count: int, within: tuple[int, int] | None, tile: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of each block; its anchors come first, then its rows."""
        at, held, block = None, [], None
        for (*key, side), piece in _runs(batches, ["g", "i", "j", "side"]):
            if key != at:
                if block is not None:
                    yield from block.found()
                at, held, block = key, [], None
            if side == 0:
                held.append(piece)
                continue
            if block is None:
                if not held:
                    continue
                block, held = Block(pa.Table.from_batches(held), count, within, tile), []
            for a in range(0, piece.num_rows, tile[1]):
                block.take(piece.slice(a, tile[1]))
        if block is not None:
            yield from block.found()

    return run


def best_rows(left: DataFrame, right: DataFrame, count: int, within: tuple[int, int] | None) -> DataFrame:
    """The best ``count`` rows of each window of each anchor in each block, as ``_FOUND``.

    ``left`` has (g, row, id, q, extra, draw), ``right`` (g, row, id, label, q, draw); only equal g meet.
    Each anchor goes to all panels of rows of its g, of which there are ``PANELS`` at most, each row to all panels of
    anchors. A row is copied only where a g has more anchors than a panel holds.
    """
    asked = left.groupBy("g").agg(F.count("*").alias("_a"), F.max(F.size("q")).alias("_d"))
    counts = right.groupBy("g").agg(F.count("*").alias("_r")).join(asked, "g", "left")
    panel = F.greatest(F.lit(1), F.floor(F.lit(PANEL_CELLS) / F.greatest("_d", F.lit(1))))
    sizes = counts.select("g", F.coalesce(F.ceil(F.col("_a") / panel), F.lit(0)).alias("_is"), F.least(F.ceil(F.col("_r") / PANEL_ROWS), F.lit(PANELS)).alias("_js"))
    shape = F.broadcast(cut(sizes.where("_is > 1 or _js > 1")))  # of large g alone, so few
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), PANELS)

    def spread(side: int, rows: DataFrame, own: str, own_count: str, over: str, over_count: str, **more: str) -> DataFrame:
        many = rows.join(shape, "g", "left").withColumns({c: F.coalesce(c, F.lit(1)).cast("long") for c in ("_is", "_js")}).where("_is > 0")
        placed = many.withColumn(own, F.floor(F.col("draw") * F.col(own_count))).withColumn(over, F.explode(F.sequence(F.lit(0).cast("long"), F.col(over_count) - 1)))
        part = F.pmod(F.pmod("g", F.lit(parts)) + F.col("i") * F.col("_js") + F.col("j"), F.lit(parts)).cast("int")
        return placed.select(part.alias("part"), "g", "i", "j", F.lit(side).alias("side"), "row", "id", "q", *[F.expr(x).alias(n) for n, x in more.items()])

    anchors = spread(0, left, "i", "_is", "j", "_js", extra="extra", label="CAST(NULL AS BIGINT)")
    rows = spread(1, right, "j", "_js", "i", "_is", extra="CAST(NULL AS ARRAY<BIGINT>)", label="label")
    order = ["g", "i", "j", "side", F.col("id").asc_nulls_last(), "row"]
    placed = anchors.unionByName(rows).repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    return placed.mapInArrow(_search(count, within, (ANCHORS, ROWS, CHUNK)), _FOUND)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """``(row, id, label, q)`` of the rows that take part: label changed where vec_id is divisible by 7, components as integers."""
    vec = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(vec, finite))
    id_ = F.col("vec_id").cast("long")
    label = F.when(id_ % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return good.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), label.alias("label"), F.transform(vec, lambda x: F.floor(256 * x)).alias("q"))


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of vectors(vec_id, embedding, label, ...).

    Rows with a null label, a null vector, or a null or non-finite component take no part. A row's
    score is its inner product with the anchor over floor(256 * x); sums of 2**53 and more within a
    chunk of dimensions are an error. Anchors are the rows whose vec_id (an integer) is divisible by 50. Null vec_ids are no
    anchors and come last among equal scores. Rows that repeat a vec_id are rows of their own, also
    as anchors, each with its own result, and equal ids and scores are taken in the order of the
    table as read. Vectors of different lengths never meet; empty ones meet with score 0. Other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = usable_rows(vectors)
    # places in panels are drawn once and then kept, so that lost tasks find the same
    keyed = written(rows.withColumn("draw", F.rand(SEED)).withColumn("asked", F.coalesce(F.col("id") % ANCHOR_STEP == 0, F.lit(False))))
    none = F.lit(_NONE).cast("long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]

    def within_g(of: DataFrame, *key: Column) -> DataFrame:
        return of.withColumn("g", F.xxhash64(*key, F.size("q")))

    own = within_g(keyed, F.lit("label"), F.col("label"))
    near = best_rows(own.where("asked").withColumn("extra", F.array("label")), own, positives, None).drop("window")
    chosen = cut(near.withColumn("window", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("window") <= positives))
    score_of = [F.max(F.when(F.col("window") == w, F.col("score"))).alias(f"s{w}") for w in range(1, positives + 1)]
    windows = chosen.groupBy(F.col("at").alias("row")).agg(*score_of)
    of_length = within_g(keyed, F.lit("length"))
    asked = of_length.where("asked").join(windows, "row").withColumn("extra", F.array("label", *[F.coalesce(f"s{w}", none) for w in range(1, positives + 1)]))
    far = best_rows(asked, of_length, negatives, (LOW, HIGH)).drop("anchor")
    best = far.withColumn("rank", F.row_number().over(Window.partitionBy("at", "window").orderBy(*order))).where(F.col("rank") <= negatives)
    positive = chosen.select("at", "window", "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(positive, ["at", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_summa_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
         CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM rows AS a JOIN rows AS r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, row_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
