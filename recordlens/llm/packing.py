"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordlens.llm.common import cut, table

CAPACITY = 1024
SEPARATOR = 2
#: Pieces that one task packs. A task wastes about one sequence, whatever the size of the corpus.
PACK_ROWS = 16384
ROWS = 512


class _ByLibrary:
    def __init__(self, path: str) -> None:
        self.path = path

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class _ByRanks(_ByLibrary):
    """A byte-level BPE tokenizer file, read as ranks: the same ids in a third of the time.

    A run of hundreds of thousands of white-space characters overflows the stack of tiktoken's
    splitter; such a text goes to the library.
    """

    def __init__(self, path: str, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        super().__init__(path)
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return super().ids(text)


def _visible_bytes() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def reader(path: str) -> _ByRanks | _ByLibrary:
    """The ids of ``tokenizers`` for a tokenizer file, one reader in each Python worker.

    Where the file is plain byte-level BPE whose merges are numbered in order, ids are found by
    rank. Any other file is read by the library itself.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges") or []]
    plain = (
        model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
        and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
        and merged == list(range(256, 256 + len(merged)))
    )
    if not plain:
        return _ByLibrary(path)
    special = {a["content"]: a["id"] for a in added}
    back = _visible_bytes()
    return _ByRanks(path, {bytes(map(back.__getitem__, word)): k for word, k in model["vocab"].items() if word not in special}, special)


def cut_points(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document start: all but the first are full."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of docs(doc_id, text, ...).

    A document's ids are those of its whole text, then ``separator``; null text counts as empty
    and gives one piece, the separator. Longer documents are cut into pieces of ``capacity``, of
    which the first may be shorter. Null doc_ids stay; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = reader(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, text in enumerate(batch["text"].to_pylist()):
                    all_ids = np.append(source.ids(text or "").astype("<u4"), np.array([separator], "<u4"))
                    points = cut_points(len(all_ids), capacity)
                    for n, (a, b) in enumerate(zip(points, [*points[1:], len(all_ids)])):
                        row.append(k), piece.append(n), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                        if ids:
                            kept.append(all_ids[a:b].astype(np.int32))
                columns = [batch["doc_id"].take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.record_batch(columns + [pa.array(kept, pa.list_(pa.int32()))] * ids, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, the items taken in the order given.

    ``count[g]`` is the number of open bins with gap g. An item goes to the gap where the sum of
    squares of the counts becomes smallest, of equal ones the smallest; a gap that it fills leaves
    the counts, and comes first. A new bin is opened only if no gap is large enough.
    """
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        left = np.flatnonzero(count[size:])
        if len(left):
            change = count[left] - count[left + size]  # half the change, without its constant
            rest = 0 if left[0] == 0 else int(left[change.argmin()])
            gap = rest + size
            chosen = opened[gap].pop()
            count[gap] -= 1
        else:
            chosen, gap, bins = bins, capacity, bins + 1
        where[k], offset[k] = chosen, capacity - gap
        if gap > size:
            opened[gap - size].append(chosen)
            count[gap - size] += 1
    return where, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows: int = PACK_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` tokens.

    Expects ``length`` in 1..capacity; all other columns are kept. Pieces are dealt evenly to
    tasks of about ``rows``, whatever their ids, and each task places its own, longest first. An
    empty table gives no rows.
    """
    held = cut(pieces)
    tasks = max(1, ceil(held.count() / rows))
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        whole = pa.Table.from_batches(found)
        whole = whole.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece") if c in names)]).combine_chunks()
        where, offset = place(whole["length"].to_numpy(), capacity)
        own = TaskContext.get().partitionId() << 40
        for b in whole.append_column("sequence_id", pa.array(where + own)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=4096):
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.repartition(tasks).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces that carry ids: the token sequences themselves."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(tokenize(docs, path or public_tokenizers.path("byte_bpe_50k.json")))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
