"""Substring deduplication against content-defined reference blocks, in place of a greedy relative Lempel-Ziv parse.

Every document is cut, left to right, into reference blocks: stretches of consecutive windows
of WINDOW words that share an anchor, the least-hashed phrase of PHRASE words in the window.
Where a block begins and ends depends on its words alone, so equal passages are cut alike, and
the index of a block is its anchor and the hash of its words. A block that is indexed at an
earlier place is copied from there, with all of its windows; matches are not extended beyond whole
blocks. Only where an anchor occurs in different blocks can a block's boundary
hide a repeated window; the windows of those blocks are looked up one by one. So the result is
that of looking up every window, while about one row for eight words is shuffled, and repeated
text only once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import WORD_GAP, cut, table

WINDOW, PHRASE = 20, 6
#: Columns of their own between the steps; a table that has them is refused.
SPANS, PACKED = "_relz_spans", "_relz_packed"
#: Words and rows that a task handles at a time, and blocks of one anchor that it sends to the anchor's group.
CHUNK_WORDS, CHUNK_ROWS, GROUP_ROWS = 600_000, 1024, 4
_CACHE = 250_000
#: How texts are compressed where they must be shuffled.
_LEVEL = 3
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLAIN, COPIED, LOOKED_UP = 0, 1, 2


class Hashes:
    """Word hashes of some texts in one row, and the hash of any stretch of words from prefix sums."""

    _known: dict[bytes, int] = {}

    def __init__(self, texts: list[str | None]) -> None:
        known, digest = Hashes._known, xxhash.xxh64_intdigest
        found, sizes = [], []
        for text in texts:
            words = (text or "").encode().split()
            sizes.append(len(words))
            for word in set(words).difference(known):
                known[word] = digest(word)
            found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            if len(known) > _CACHE:
                known.clear()
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        words = np.concatenate([*found, np.zeros(0, np.uint64)])
        self.sums = []
        for which in range(2):
            powers = _powers(which, len(words))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)], dtype=np.uint64)]))

    def of(self, at: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hash of ``length`` words from place ``at`` on; equal stretches have equal hashes anywhere."""
        sums, inverse = self.sums[which], _powers(which, len(self.sums[which]), True)
        h = (sums[at + length] - sums[at]) * inverse[at] + np.asarray(length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, size: int, inverse: bool = False) -> np.ndarray:
    """Powers of a base (or of its inverse) modulo 2**64, kept from call to call."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < size + 1:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        steps = np.full(max(size + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[which, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have


def blocks(hashes: Hashes, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """Of all texts the blocks: text, first window, number of windows, anchor hash."""
    width = window - phrase + 1
    text, first, count, anchor = [], [], [], []
    all_grams = len(hashes.sums[0]) - phrase
    grams = hashes.of(np.arange(max(0, all_grams)), phrase) if all_grams > 0 else np.zeros(0, np.uint64)
    for k in np.flatnonzero(hashes.sizes >= window):
        s, n = hashes.starts[k], hashes.sizes[k] - window + 1
        own = grams[s : s + n + width - 1]
        least = np.lib.stride_tricks.sliding_window_view(own, width).argmin(axis=1) + np.arange(n)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        text.append(np.full(len(begin), k))
        first.append(begin)
        count.append(np.diff(np.r_[begin, n]))
        anchor.append(own[least[begin]])
    if not text:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, (text, first, count, anchor)))


def _pack(names: list[str]):
    """Texts compressed for the shuffle: ``text`` becomes PACKED, the columns ``names`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=_LEVEL)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                packed = [None if t is None else press.compress(t.encode()) for t in batch["text"].to_pylist()]
                yield pa.record_batch([*(batch[n] for n in names), pa.array(packed, pa.binary())], [*names, PACKED])

    return run


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    if PACKED not in batch.schema.names:
        return batch["text"].to_pylist()
    expand = zstandard.ZstdDecompressor()
    return [None if p is None else expand.decompress(p).decode() for p in batch[PACKED].to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches with their texts, in slices of about CHUNK_WORDS words, judged by length."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK_ROWS):
            batch = whole.slice(at, CHUNK_ROWS)
            texts = _texts(batch)
            sizes = np.cumsum([len(t or "") // 6 + 1 for t in texts])
            cuts = np.searchsorted(sizes, np.arange(CHUNK_WORDS, sizes[-1], CHUNK_WORDS)) + 1
            edges = np.unique(np.r_[0, cuts, batch.num_rows])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield batch.slice(a, b - a), texts[a:b]


def _span_arrays(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """First window, number of windows and mark of the spans of each row, None without any."""
    column = batch[SPANS]
    flat = column.flatten()
    start, windows, mark = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "windows", "mark"))
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [(start[a:b], windows[a:b], mark[a:b]) if b > a else None for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, with whether each is known; nulls come first in any order."""
    column = batch["doc_id"]
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _rows(batch: pa.RecordBatch, text: np.ndarray, key: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    signed = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, mark)]
    columns = [*signed, batch["doc_id"].take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(kind.astype(np.int32))]
    return pa.record_batch(columns, ["key", "mark", "doc_id", "start", "windows", "kind"])


_SCHEMA = "key long, mark long, doc_id long, start int, windows int, kind int"


def _within_chunk(batch: pa.RecordBatch, text: np.ndarray, start: np.ndarray, key: np.ndarray, mark: np.ndarray):
    """Sorts rows by key, mark and place; tells the first of each (key, mark) and those after it."""
    ids, known = _ids(batch)
    order = np.lexsort((start, ids[text], known[text], mark, key))
    k, m, i, v, s = key[order], mark[order], ids[text][order], known[text][order], start[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = (i != i[head]) | (v != v[head]) | (s != s[head])
    return order, new, later & ~new, k


def _parse(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of each chunk: each distinct one once, plus the chunk's own copies."""
        for batch, texts in _chunks(batches):
            hashes = Hashes(texts)
            text, first, count, anchor = blocks(hashes, window, phrase)
            if not len(text):
                continue
            mark = hashes.of(hashes.starts[text] + first, count + window - 1, 1)
            order, new, copied, key = _within_chunk(batch, text, first, anchor, mark)
            heads = np.flatnonzero(new)
            begin = np.maximum.accumulate(np.where(np.r_[True, key[heads][1:] != key[heads][:-1]], np.arange(len(heads)), 0))
            kind = np.full(len(order), -1)
            kind[heads] = np.where(np.arange(len(heads)) - begin < GROUP_ROWS, PLAIN, LOOKED_UP)
            kind[copied] = COPIED
            chosen = np.flatnonzero(kind >= 0)
            o = order[chosen]
            spread = hashes.of(hashes.starts[text[o]] + first[o], 1) + first[o].astype(np.uint64) + text[o].astype(np.uint64)
            yield _rows(batch, text[o], np.where(kind[chosen] == PLAIN, anchor[o], spread * np.uint64(_BASES[0])), mark[o], first[o], count[o], kind[chosen])

    return run


def _look_up(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the blocks to look up: each distinct one once a chunk, plus the chunk's copies."""
        for batch, texts in _chunks(batches):
            hashes = Hashes(texts)
            text, at = [], []
            for k, spans in enumerate(_span_arrays(batch)):
                for first, n in zip(*map(np.ndarray.tolist, spans[:2])) if spans else ():
                    if first + n + window - 1 <= hashes.sizes[k]:
                        at.append(np.arange(first, first + n))
                        text.append(np.full(n, k))
            if not text:
                continue
            text, at = np.concatenate(text), np.concatenate(at)
            key, mark = (hashes.of(hashes.starts[text] + at, window, which) for which in (0, 1))
            order, new, copied, _ = _within_chunk(batch, text, at, key, mark)
            kind = np.where(new, PLAIN, np.where(copied, COPIED, -1))
            chosen = np.flatnonzero(kind >= 0)
            o = order[chosen]
            spread = np.where(kind[chosen] == PLAIN, key[o], (key[o] + at[o].astype(np.uint64) + text[o].astype(np.uint64)) * np.uint64(_BASES[0]))
            yield _rows(batch, text[o], spread, mark[o], at[o], np.ones(len(o), int), kind[chosen])

    return run


def _resolved(rows: DataFrame) -> DataFrame:
    """``rows`` with whether the (key, mark) starts earlier, and whether the key has other marks."""
    dealt = rows.repartition("key")
    same = Window.partitionBy("key", "kind", "mark").orderBy("doc_id", "start")
    around = Window.partitionBy("key", "kind")
    return (
        dealt.withColumn("first", F.first(F.struct("doc_id", "start")).over(same))
        .withColumn("later", ~F.struct("doc_id", "start").eqNullSafe(F.col("first")))
        .withColumn("mixed", F.min("mark").over(around) != F.max("mark").over(around))
        .drop("first")
    )


def _spans(rows: DataFrame) -> DataFrame:
    """Spans by document; a document's spans are no more than its words."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "mark")).alias(SPANS))


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    renamed = spans.withColumnRenamed("doc_id", "_doc")
    return docs.join(renamed, docs["doc_id"].eqNullSafe(renamed["_doc"]), how).drop("_doc")


def _remove(names: list[str], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            spans = _span_arrays(batch)
            touched = [k for k, s in enumerate(spans) if s]
            hashes = Hashes([texts[k] for k in touched])
            n_words = np.array([len((t or "").encode().split()) for t in texts], np.int64)
            n_removed = np.zeros(len(texts), np.int64)
            for n, k in enumerate(touched):
                start, length, mark = spans[k][0], spans[k][1] + window - 1, spans[k][2]
                fits = start + length <= n_words[k]
                start, length, mark = start[fits], length[fits], mark[fits]
                right = hashes.of(hashes.starts[n] + start, length, 1).view(np.int64) == mark  # rows may share an id
                edge = np.zeros(n_words[k] + 1, np.int64)
                np.add.at(edge, start[right], 1)
                np.add.at(edge, (start + length)[right], -1)
                covered = np.cumsum(edge[:-1]) > 0
                if covered.any():
                    words = texts[k].encode().split()
                    texts[k] = b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode()
                    n_removed[k] = covered.sum()
            columns = [pa.array(texts, pa.string()) if name == "text" else batch[name] for name in names]
            yield pa.record_batch([*columns, pa.array(n_words), pa.array(n_removed)], [*names, "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` without each word that a window of ``window`` words covers which also starts earlier.

    Earlier is a smaller doc_id (an integer), or the same document and an earlier start; windows
    are judged on the input. Adds ``n_words`` and ``n_removed``; a text that loses words comes back
    as the kept ones joined by one space, any other unchanged. A null text has no words. A null
    doc_id counts as the smallest; rows that share a doc_id are one document to the order, so equal
    rows keep their words; each row loses only what it holds itself. All rows and columns stay,
    columns named as an added one are replaced; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    if {SPANS, PACKED} & set(names):
        raise ValueError(f"columns {SPANS} and {PACKED} are reserved")
    docs = docs.select(*names)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parsed = _resolved(lean.mapInArrow(_parse(window, phrase), _SCHEMA))
    copied = (F.col("kind") == COPIED) | ((F.col("kind") == PLAIN) & F.col("later"))
    found = cut(
        parsed.where(copied | (F.col("kind") == LOOKED_UP) | F.col("mixed"))
        .select("doc_id", "start", "windows", "mark", copied.alias("copied"))
    )
    unsure = _spans(found.where(~F.col("copied")))
    packed = lean.mapInArrow(_pack(["doc_id"]), f"doc_id long, {PACKED} binary")
    windows = _resolved(_with_spans(packed, unsure, "inner").select("doc_id", PACKED, SPANS).mapInArrow(_look_up(window), _SCHEMA))
    repeated = windows.where((F.col("kind") == COPIED) | F.col("later")).select("doc_id", "start", "windows", "mark")
    spans = _spans(found.where("copied").select("doc_id", "start", "windows", "mark").union(repeated))
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema}
    others = [n for n in names if n != "text"]
    whole = docs.mapInArrow(_pack(others), ", ".join([fields[n] for n in others] + [f"{PACKED} binary"]))
    joined = _with_spans(whole, spans, "left").select(*others, PACKED, SPANS)
    return joined.mapInArrow(_remove(names, window), f"{', '.join(fields[n] for n in names)}, n_words long, n_removed long")


def op4_relz(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")), WORD_GAP, " ")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
