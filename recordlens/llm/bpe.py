"""Byte-level BPE through a sentencepiece model that is serialised from a rank file."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.common import table

#: Pre-tokens kept with their ids in each Python worker.
CACHE = 300_000
ROWS = 128
#: Pre-tokens longer than this many characters are encoded each time.
LONGEST_CACHED = 48


def byte_map(raw: bytes) -> str:
    """Each byte as one character from U+0100 on, where no white space or special piece is."""
    return raw.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes as length-delimited, float as 32-bit, int as varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: piece k is the k-th rank's bytes.

    Pieces are byte-mapped and scored by negative rank, so that the merge of the best score is
    the merge of the least rank; normalisation is identity. The unknown piece comes last.
    """
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, byte_map(piece).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, plain)


@lru_cache(maxsize=1)
def _newer_characters() -> list[str]:
    """Letters and digits of ``regex``'s Unicode tables that tiktoken's older tables lack.

    tiktoken treats these as symbols, so pre-tokens are split as if they were a private-use
    character. Compared at load, whatever the versions of the two libraries.
    """
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        plain = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        newer |= set(regex.findall(kind, text)).difference(bytes(plain.encode_ordinary(text)).decode())
    return sorted(newer)


def _ranges(characters: list[str]) -> list[tuple[str, str]]:
    """Sorted characters as runs of adjacent ones: first and last of each."""
    runs: list[list[str]] = []
    for c in characters:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return [(a, b) for a, b in runs]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path}: no rank for the bytes {missing}")
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([r for _, r in order], np.int32)
        self.bytes_of_rank = {r: piece for piece, r in order}
        self.whole = ranks
        self.pattern = regex.compile(pattern)
        newer = _newer_characters()
        self.stand_in = dict.fromkeys(map(ord, newer), "\ue000")
        self.newer = re.compile("[" + "".join(f"{a}-{b}" for a, b in _ranges(newer)) + "]").search if newer else (lambda text: None)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.known: dict[str, bytes] = {}

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")  # a quick way out: no newer character is that old
            return self.pattern.findall(text)
        except UnicodeEncodeError:
            if not self.newer(text):
                return self.pattern.findall(text)
        masked = text.translate(self.stand_in)  # the same length, so the places are those of the text
        return [text[m.start() : m.end()] for m in self.pattern.finditer(masked)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of the pre-tokens as little-endian 32-bit integers; a pre-token that is a piece is that piece."""
        found, rest = {}, []
        for word in words:
            rank = self.whole.get(word.encode("utf-8", "replace"))
            if rank is None:
                rest.append(word)
            else:
                found[word] = struct.pack("<i", rank)
        for word, ids in zip(rest, self.model.encode([byte_map(w.encode("utf-8", "replace")) for w in rest], out_type=int, num_threads=1) if rest else []):
            found[word] = self.rank_of_piece[ids].astype("<i4").tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        words = self.find(text)
        new = set(words).difference(self.known)
        if not new:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<i4")
        found = self._learn(list(new))
        if len(self.known) + len(found) > CACHE:
            self.known = {w: self.known[w] for w in set(words).intersection(self.known)}
        long = {w: ids for w, ids in found.items() if len(w) > LONGEST_CACHED}
        self.known.update((w, ids) for w, ids in found.items() if w not in long)
        return np.frombuffer(b"".join(long[w] if w in long else self.known[w] for w in words), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of_rank.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder in each Python worker, reused by its later tasks."""
    return ByteBpe(path, pattern)


def _ids(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` for each row of docs(doc_id, text, ...); null text counts as empty.

    Each match of ``pattern`` is encoded separately, without special tokens. ``decoded`` adds the
    bytes that the ids stand for. Rows come back as often as they came, in any order; null doc_ids
    and other columns don't matter; empty texts give empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                arrays = [bpe.encode(text or "") for text in batch["text"].to_pylist()]
                columns = [batch["doc_id"], _ids(arrays)]
                if decoded:
                    columns.append(pa.array([bpe.decode(ids) for ids in arrays], pa.binary()))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, decoded)``: the bytes of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                raw = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch["ids"].to_pylist()]
                yield pa.record_batch([batch["doc_id"], pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
