"""Ranked lexical search by a quantised index of two levels: byte impacts bound, exact integers rescore.

The first level has a byte for each term of a document: its impact rounded up to 1/255 of the
largest possible one. Sums of bytes bound a document's score from above, and as no byte is a whole
step too high, also from below. Documents whose upper bound reaches the k-th greatest lower bound
are scored again from the second level, term frequencies and lengths, in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, remove_folder, table, written_at
from recordlens.llm.lexicon import Lexicon, ragged

TOP = 10
#: Items are searched in blocks of about so many characters; a block's terms are held by every task.
BLOCK_CHARS = 4_000_000
#: About so many bytes of text are taken apart at a time, and documents bounded at a time.
SLICE, ROWS = 2_000_000, 10_000
#: No impact is larger: TF_SCALE * tf // (1000 * tf + 8 * m) is less than TF_SCALE / 1000.
TF_SCALE, LARGEST, STEPS = 1_000_000_000, 1_000_000, 255

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the terms in some bytes: runs of letters and digits of ASCII and of all other characters."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_TERM[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, repeats included, in lower case as to A-Z."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    whole = raw.tobytes()
    return [whole[a : a + n] for a, n in zip(*map(np.ndarray.tolist, term_places(raw)))]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows and their texts as bytes, about SLICE at a time; a longer text comes in pieces that end outside of terms."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        at = 0
        while at < len(raw):
            end = min(len(raw), at + SLICE - size)
            if end < len(raw):
                stops = np.flatnonzero(~_IN_TERM[np.frombuffer(raw, np.uint8, count=min(len(raw) - end, 1 << 16), offset=end)])
                while not len(stops) and end < len(raw):  # a term of more than 64 KB
                    end = min(len(raw), end + (1 << 16))
                    stops = np.flatnonzero(~_IN_TERM[np.frombuffer(raw, np.uint8, count=min(len(raw) - end, 1 << 16), offset=end)])
                end = end + int(stops[0]) if len(stops) else len(raw)
            rows.append(k)
            held.append(raw[at:end])
            size += end - at
            at = end
            if size >= SLICE:
                yield np.array(rows), held
                rows, held, size = [], [], 0
    if held:
        yield np.array(rows), held


def postings(docs: DataFrame, vocabulary: Lexicon) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` for each row of docs: its number of terms, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.arrays["weight"])
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, texts in _pieces(batch["text"].to_pylist()):
                raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
                start, length = term_places(raw)
                begins = np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts]
                row = rows[np.searchsorted(begins, start, side="right") - 1]
                n += np.bincount(row, minlength=batch.num_rows)
                term = vocabulary.find(raw, start, length)
                known = term >= 0
                key, count = np.unique(row[known] * size + term[known], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, place, np.concatenate(counts))
            row, term = np.divmod(key, max(1, size))
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.record_batch([batch["doc_id"], pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Statistics(NamedTuple):
    """Documents with a term, all their terms, and the weight of each term of the vocabulary."""

    documents: int
    terms: int
    weight: np.ndarray


def statistics(counted: DataFrame, size: int) -> Statistics:
    """Counted over all rows of ``postings``; what comes to the driver has a row for a term of the vocabulary at most."""
    totals = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    n = totals["documents"]
    return Statistics(n, totals["terms"], np.array([floor(1000 * log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))


def exact_impacts(tf: np.ndarray, n: np.ndarray, known: Statistics) -> np.ndarray:
    """The score of a term for each unit of its weight; ``n`` is the number of terms of its document."""
    m = 100 - 75 + (75 * n * known.documents) // max(1, known.terms)
    return (TF_SCALE * tf) // (1000 * tf + 8 * m)


def quantised(counted: DataFrame, known: Statistics) -> DataFrame:
    """``postings`` with ``impacts``: a byte for each term, its exact impact rounded up to a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            exact = exact_impacts(tf, np.repeat(batch["n"].to_numpy(), sizes), known)
            raw = (-(-exact * STEPS // LARGEST)).astype(np.uint8).tobytes()
            ends = np.r_[0, np.cumsum(sizes)].tolist()
            bytes_ = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.record_batch([*batch.columns, bytes_], [*batch.schema.names, "impacts"])

    return counted.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>, impacts binary")


class Item(NamedTuple):
    """One asked text: its distinct terms by number, and their weights times their repeats."""

    terms: np.ndarray
    weight: np.ndarray


class Best:
    """The best documents of one item so far: scores, ids, and whether the id is null (such come last)."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score, self.doc, self.lacks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A document needs at least this score."""
        return int(self.score[-1]) if len(self.score) >= self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, lacks: np.ndarray) -> None:
        score, doc, lacks = np.r_[self.score, score], np.r_[self.doc, doc], np.r_[self.lacks, lacks]
        order = np.lexsort((doc, lacks, -score))[: self.top]
        self.score, self.doc, self.lacks = score[order], doc[order], lacks[order]


class Block:
    """Some documents of the index, their terms sorted so that each term's documents lie together."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: int, known: Statistics) -> None:
        self.known, self.rows = known, batch.num_rows
        self.doc = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        self.lacks = ~batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        self.n = batch["n"].to_numpy()
        sizes = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = batch["terms"].flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(self.rows), sizes)[order]
        self.impact = np.frombuffer(b"".join(batch["impacts"].to_pylist()), np.uint8)[order]
        self.tf = batch["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)[order]
        self.ends = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def search(self, item: Item, best: Best) -> None:
        """Bounds of all documents by bytes; those that may be among the best are scored from frequencies.

        Sums of bytes stay far below 2**53, so doubles hold them exactly.
        """
        first = self.ends[item.terms]
        count = self.ends[item.terms + 1] - first
        at = ragged(first, count)
        if not len(at):
            return
        row, weight = self.row[at], np.repeat(item.weight, count)
        upper = np.bincount(row, weight * self.impact[at], self.rows)
        lower = upper - np.bincount(row, weight, self.rows)
        touched = np.flatnonzero(upper > 0)
        if not len(touched):
            return
        least = np.partition(lower[touched], -best.top)[-best.top] if len(touched) > best.top else -np.inf
        wanted = touched[(upper[touched] >= least) & (upper[touched] * LARGEST >= float(best.floor) * STEPS)]
        chosen = np.full(self.rows, -1)
        chosen[wanted] = np.arange(len(wanted))
        own = chosen[row]
        use = own >= 0
        score = np.zeros(len(wanted), np.int64)
        np.add.at(score, own[use], weight[use] * exact_impacts(self.tf[at[use]], self.n[row[use]], self.known))
        positive = score > 0
        best.add(score[positive], self.doc[wanted[positive]], self.lacks[wanted[positive]])


def best_of_tasks(index: DataFrame, items: list[Item], known: Statistics, top: int) -> DataFrame:
    """``(item, doc_id, score)``: of each task's part of the index its ``top`` documents for each item."""
    vocabulary = len(known.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                block = Block(whole.slice(at, ROWS), vocabulary, known)
                for item, own in zip(items, best):
                    block.search(item, own)
        number = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        if len(number):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.lacks for b in best]))
            yield pa.record_batch([pa.array(number.astype(np.int32)), doc, pa.array(np.concatenate([b.score for b in best]))], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _search_block(docs: DataFrame, asked: list[list[bytes]], top: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` for the items of one block, by their place in ``asked``."""
    spark = docs.sparkSession
    words = sorted({t for terms in asked for t in terms})
    number = {t: k for k, t in enumerate(words)}
    vocabulary = Lexicon.compile(words, weight=np.zeros(len(words), np.int8))
    counted, place = written_at(postings(docs, vocabulary))
    known = statistics(counted, len(words))
    index, place_of_index = written_at(quantised(counted, known))
    items = []
    for terms in asked:
        own, repeats = np.unique([number[t] for t in terms], return_counts=True) if terms else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        items.append(Item(own.astype(np.int64), known.weight[own.astype(np.int64)] * repeats))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best_of_tasks(index, items, known, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = cut(ranked)
    for folder in (place, place_of_index):
        remove_folder(spark, folder)
    return out


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best rows of docs(doc_id, text, ...) for each of items(item_id, text, ...).

    Only scores above 0 count; equal ones come by ascending doc_id (an integer), null ids last. Null
    texts have no terms. Rows that repeat a doc_id are documents of their own, and rows that repeat
    an item_id are items of their own with rows of their own. Very long texts are read whole, in
    pieces. Other columns, whatever their names, are ignored. Without items or documents there are
    no rows. Items are searched in blocks of about BLOCK_CHARS characters, each block against all
    documents; the index of a block has all documents and the block's terms.
    """
    spark = docs.sparkSession
    plain = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / BLOCK_CHARS))
    dealt = plain.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()
        ranked = _search_block(docs, [terms_of(r["text"]) for r in rows], top)
        kind = items.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {kind}")
        named = ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = named if found is None else found.union(named)
    return found


def op12_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, totals GROUP BY term, docs),
asked AS (SELECT item_id, term, count(*) AS repeats
          FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) AS q GROUP BY item_id, term),
scores AS (SELECT item_id, doc_id,
                  CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
           GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
