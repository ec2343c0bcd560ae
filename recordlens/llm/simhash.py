"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.common import connected_components, cut, least_labels, table

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 512
BITS = 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned SimHash of one text: a bit is 1 if set in over half the shingle hashes.

    A-Z are lower-cased, words are split at ASCII white space, shingles keep repeats; fewer
    words than ``width`` make one shingle, no words (or null) give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones, seen = np.zeros(BITS, np.int64), 0
    for start in range(0, count, 65536):  # long texts in bounded pieces
        size = min(65536, count - start)
        h = np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(size))), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        seen += size
    return int(np.packbits(ones * 2 > seen, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows)
        rest = [name for name in batch.schema.names if name != "text"]
        yield pa.record_batch([*(batch[name] for name in rest), pa.array(fp.view(np.int64))], [*rest, "fp"])


def simhash(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, fp)`` for each row of docs(doc_id, text, ...): a hash of the text, and the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _mark()).mapInArrow(_fingerprints, f"doc_id {kind}, mark long, fp long")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def _block_masks(count: int, radius: int, tile: int) -> list[int]:
    """Bit masks of which any two fingerprints within ``radius`` agree on at least one.

    The 64 bits are cut into radius + spare blocks; by the pigeonhole principle two
    fingerprints that differ in at most ``radius`` bits agree on some choice of ``spare``
    blocks. A mask keeps as many bits as leave about ``tile`` fingerprints to a value, so the
    number of comparisons grows with the number of fingerprints, not with its square.
    """
    need = max(0, ceil(log2(max(1, count) / tile)))
    spare = next((s for s in range(1, 4) if BITS * s // (radius + s) >= need), 3)
    edges = [BITS * k // (radius + spare) for k in range(radius + spare + 1)]
    masks = []
    for chosen in combinations(range(radius + spare), spare):
        bits = [b for k in chosen for b in range(edges[k], edges[k + 1])][:need]
        masks.append(sum(1 << b for b in bits))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tile_links(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (k, lo, hi); each such group holds one tile or two."""
        rest: list[np.ndarray] = []
        rest_key = None

        def links(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = not len(right)
            right = left if same else right
            found_i, found_j = [], []
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                near = np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= radius
                i, j = np.nonzero(near)
                found_i.append(rows[i])
                found_j.append(right[j])
            i, j = np.concatenate(found_i or [left]), np.concatenate(found_j or [left])
            low = least_labels(i, j, len(fp))
            moved = np.flatnonzero(low != np.arange(len(fp)))
            return fp[moved], fp[low[moved]]

        def flush() -> list[tuple[np.ndarray, np.ndarray]]:
            if not rest:
                return []
            data = np.concatenate(rest, axis=1)
            return [links(data[0].view(np.uint64), data[1])]

        for batch in batches:
            if not batch.num_rows:
                continue
            k, lo, hi, side, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "lo", "hi", "side", "fp"))
            key = np.stack([k, lo, hi])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            out = []
            for s, e in zip(starts, np.r_[starts[1:], len(fp)]):
                this = tuple(key[:, s])
                if this != rest_key:
                    out += flush()
                    rest, rest_key = [], this
                rest.append(np.stack([fp[s:e], side[s:e].astype(np.int64)]))
            if out:
                a, b = (np.concatenate([o[n] for o in out]).view(np.int64) for n in (0, 1))
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
        for a, b in flush():
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return compare


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the same fingerprints as all pairs within ``radius`` do.

    ``distinct(fp)`` holds each fingerprint once. Fingerprints meet in the blocks of
    ``_block_masks``. A block of at most two tiles is compared whole. A larger one is dealt
    into tiles by population count and a hash; a tile is paired only with tiles whose
    population count differs by at most ``radius``. Tiles are compared exactly; of each, a
    spanning forest is returned instead of all pairs.
    """
    masks = _block_masks(distinct.count(), radius, tile)
    rows = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for n, m in enumerate(masks)])).alias("x")
    ).select("fp", F.xxhash64("x.t", "x.v").alias("k"), F.expr("cast(bit_count(fp) as long)").alias("p"))
    large = (
        rows.groupBy("k", "p").count()
        .withColumn("n", F.ceil(F.col("count") / tile))
        .groupBy("k").agg(F.sum("count").alias("all"), F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("n"))
        .where(F.col("all") > 2 * tile).select("k", "n")
    )
    split = rows.join(large, "k", "left")
    own = F.expr("p * 1048576 + pmod(xxhash64(fp), n[p])")
    pairs = F.expr(
        f"""filter(flatten(transform(sequence(greatest(0L, p - {radius}L), least({BITS}L, p + {radius}L)),
            q -> if(n[q] is null, cast(array() as array<struct<lo:long,hi:long,side:int>>),
                transform(sequence(0L, n[q] - 1L), s -> struct(
                    least(own, q * 1048576 + s) as lo, greatest(own, q * 1048576 + s) as hi,
                    if(own <= q * 1048576 + s, 0, 1) as side))))), x -> true)"""
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("side")))
    dealt = (
        split.withColumn("own", F.when(F.col("n").isNotNull(), own))
        .select("fp", "k", F.explode(F.when(F.col("n").isNull(), whole).otherwise(pairs)).alias("x"))
        .select("k", "x.lo", "x.hi", "x.side", "fp")
    )
    return (
        dealt.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")
        .mapInArrow(_tile_links(radius), "a long, b long")
    )


def _grouped(docs: DataFrame, radius: int, tile: int) -> DataFrame:
    """``(doc_id, mark, fp, component_id)`` of each row of ``docs``."""
    fps = cut(simhash(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(fingerprint_links(classes.select("fp"), radius, tile))
    rooted = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "mark", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fp, component_id)``.

    ``component_id`` is the smallest doc_id that chains of links reach, itself included. Null
    and empty texts have fingerprint 0 and are linked like any other; very long texts are hashed
    whole, in bounded pieces; a null doc_id is kept and takes its component's smallest id that is
    not null (null if there is none); repeated rows come back as often as they came; other columns,
    whatever their names, are ignored. An empty table gives no rows.
    """
    return _grouped(docs, radius, tile).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; all other members of it go.

    Rows are judged by their own text, so of two texts with one doc_id each keeps or loses its
    place in its own group. Rows equal in doc_id and text stay or go together. A null doc_id stays
    only in a group that has no other id. All columns stay, whatever their names.
    """
    found = _grouped(docs, radius, TILE)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_doc"), "mark").distinct()
    same = docs["doc_id"].eqNullSafe(gone["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["mark"])
    return docs.join(gone, same, "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
