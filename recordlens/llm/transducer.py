"""Byte-level BPE by a transducer lexicon: frequent words are compiled with their ids, others are merged."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from recordlens.llm.common import remove_folder, shared_folder, table, write_bytes, written_at
from recordlens.llm.lexicon import Lexicon, ragged

#: The lexicon holds at most so many words, the most frequent of the corpus, none longer than LONGEST bytes.
WORDS, LONGEST = 131_072, 48
#: About so many characters are encoded at a time.
SLICE = 1_000_000
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# The endings that the splitting pattern takes after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Inside these, where a word and a space meet, a text may be cut without changing its words.
_SAFE_CUT = re.compile(r"[a-zA-Z](?= [a-zA-Z])")


def _visible_bytes() -> dict[str, int]:
    """The characters by which byte-level files write bytes: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Merges:
    """A byte-level BPE file as ranks: exact merges of one word, and the bytes and special strings of its ids.

    Only files whose merges are numbered in order, with no normalizer, prefix space or special
    tokens that take white space, can be read so; others are refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges") or []]
        plain = (
            model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and not spec.get("post_processor")
            and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
            and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or " " in a["content"] for a in added)
            and merged == list(range(256, 256 + len(merged)))
        )
        if not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE file with merges numbered in order")
        self.special = {a["content"]: a["id"] for a in added}
        back = _visible_bytes()
        ranks = {bytes(map(back.__getitem__, word)): k for word, k in model["vocab"].items() if word not in self.special}
        self.bytes_of_id = {k: word for word, k in ranks.items()} | {k: word.encode() for word, k in self.special.items()}
        whole_word = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.merge = whole_word.encode_ordinary
        found = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, found)) + ")").split if found else None


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One in each Python worker, reused by its later tasks."""
    return Merges(path)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every character as the tokenizers library's own patterns have it."""
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    text = "".join(map(chr, points.tolist()))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        inside = np.ones(len(points), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        classes[points[inside]] = kind
    return classes


def word_starts(codes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of joined texts start; texts start at ``first``.

    Runs of letters, digits and other characters are words, with a space before them if there is
    one; of white space before such a run the last character is left to it, or is a word; an
    apostrophe that starts a word takes the endings of ENDINGS.
    """
    n = len(codes)
    kind = classes[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    fresh[n] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n])  # white space before a run
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    marks = np.flatnonzero((codes[:-1] == 0x27) & start[: n - 1] & (kind[1:] == LETTER) & ~fresh[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(marks):
        one = codes[marks + 1]
        two = codes[np.minimum(marks + 2, n - 1)]
        inside = ~fresh[marks + 2]
        size = np.zeros(len(marks), np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                fits &= inside & (two == ord(ending[1]))
            size[fits] = len(ending)
        marks, size = marks[size > 0], size[size > 0]
        start[marks + 1] = False
        start[marks + 1 + size] = True
    return np.flatnonzero(start[:n])


class Coder:
    """Encoder and decoder of one file: words in the lexicon have their ids there, others are merged."""

    def __init__(self, model: Merges, lexicon: Lexicon) -> None:
        self.model, self.lexicon = model, lexicon
        self.classes, self.ids, self.id_ends = (lexicon.arrays[n] for n in ("classes", "ids", "id_ends"))
        self.known, self.known_ends = lexicon.arrays["bytes"], lexicon.arrays["byte_ends"]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has; no special strings in them."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = word_starts(codes, self.classes, edges[:-1][sizes > 0])
        if len(raw) == len(codes):
            begin = at
        else:
            width = np.ones(len(codes), np.int8)
            for limit in (0x80, 0x800, 0x10000):
                width += codes >= limit
            begin = (np.cumsum(width, dtype=np.int64) - width)[at]
        length = np.diff(np.r_[begin, len(raw)])
        word = self.lexicon.find(raw, begin, length)
        unseen = np.flatnonzero(word < 0)
        # unseen words get numbers behind the lexicon's, each distinct one of the slice once
        whole = raw.tobytes()
        fresh: dict[bytes, int] = {}
        known = len(self.id_ends) - 1
        own = [fresh.setdefault(whole[a : a + n], known + len(fresh)) for a, n in zip(begin[unseen].tolist(), length[unseen].tolist())]
        merged = [self.model.merge(w.decode()) for w in fresh]
        word[unseen] = own
        ids = np.concatenate([self.ids, np.array([i for m in merged for i in m], np.int32)]) if merged else self.ids
        ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(m) for m in merged], dtype=np.int64)]) if merged else self.id_ends
        counts = (ends[1:] - ends[:-1])[word]
        of_text = np.searchsorted(at, edges)  # the first word of each text
        return ids[ragged(ends[word], counts)], np.diff(np.r_[0, np.cumsum(counts)][of_text])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        if self.model.split is None or not any(s in t for t in texts for s in self.model.special):
            return self._plain(texts)
        parts = [self.model.split(t) for t in texts]  # odd parts are special strings
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [part for p in parts for part in p]
        odd = np.array([k % 2 == 1 for p in parts for k in range(len(p))])
        ids, counts = self._plain([("" if o else part) for part, o in zip(flat, odd)])
        places = np.cumsum(counts)[odd]
        ids = np.insert(ids, places, [self.model.special[part] for part, o in zip(flat, odd) if o])
        return ids, np.bincount(owner, counts + odd, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        size = (self.known_ends[1:] - self.known_ends[:-1])[ids]
        raw = self.known[ragged(self.known_ends[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str], bool]]:
    """Texts in order, about SLICE characters at a time: first row, parts, whether they are pieces of one long text."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if len(text) <= SLICE:
            if size + len(text) > SLICE:
                yield at, texts[at:k], False
                at, size = k, 0
            size += len(text)
            continue
        if at < k:
            yield at, texts[at:k], False
        pieces, begin = [], 0
        while begin < len(text):
            cut = _SAFE_CUT.search(text, begin + SLICE)
            end = cut.end() if cut else len(text)
            pieces.append(text[begin:end])
            begin = end
        yield k, pieces, True
        at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:], False


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The most frequent words of all rows of docs(text, ...), counted on Spark: as many as ``most`` holds of whole counts.

    Words of equal counts are all in or all out, so a histogram of the counts gives the least one,
    and only the words themselves come to the driver. Words are found by the JVM's own character
    classes. Where these differ from the tokenizer's, a word in the lexicon is never asked for, or
    one that is asked for isn't there and is merged.
    """
    word = F.explode(F.regexp_extract_all("text", F.lit(public_tokenizers.PATTERN), F.lit(0))).alias("word")
    all_counts = docs.select(word).groupBy("word").count().where((F.col("count") > 1) & (F.octet_length("word") <= LONGEST))
    counts, place = written_at(all_counts)
    above = Window.orderBy(F.col("count").desc())  # over one row for each of at most `most` counts
    sizes = counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.col("count").desc()).limit(most)
    least = sizes.withColumn("held", F.sum("words").over(above)).where(F.col("held") <= most).agg(F.min("count")).first()[0]
    found = [] if least is None else [r["word"] for r in counts.where(F.col("count") >= least).select("word").collect()]
    remove_folder(docs.sparkSession, place)
    return found


def compile_lexicon(words: list[str], path: str) -> Lexicon:
    """The words with their ids as a transducer, with what else a coder needs: character classes and the ids' bytes."""
    model = merges(path)
    raw = sorted({w.encode() for w in words if w})
    ids = [model.merge(w.decode()) for w in raw]
    known = [model.bytes_of_id.get(k, b"") for k in range(max(model.bytes_of_id) + 1)]
    return Lexicon.compile(
        raw, classes=character_classes(), ids=np.array([i for m in ids for i in m], np.int32), id_ends=np.cumsum([0, *map(len, ids)]),
        bytes=np.frombuffer(b"".join(known), np.uint8), byte_ends=np.cumsum([0, *map(len, known)]),
    )


def share_lexicon(spark: SparkSession, lexicon: Lexicon) -> str:
    """Puts the file into the shared folder and has Spark carry it to executors, also to later ones; its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{shared_folder(spark)}/{name}"
    write_bytes(spark, place, lexicon.to_bytes())
    spark.sparkContext.addFile(place)
    return name


@lru_cache(maxsize=2)
def coder(path: str, name: str) -> Coder:
    """One coder in each Python worker; the workers of a machine share the mapped lexicon."""
    return Coder(merges(path), Lexicon.mapped(SparkFiles.get(name)))


def encode(docs: DataFrame, path: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of each row of docs(doc_id, text, ...), with the shared file ``lexicon``.

    The ids are those of the tokenizers library without added special tokens, truncation and
    padding; strings of special tokens in a text are those tokens. ``decoded`` adds the text that
    the ids stand for. Null texts count as empty and have no ids; very long texts are encoded in
    pieces cut between words; rows come back as often as they came; null doc_ids stay; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon)
        for batch in batches:
            for row, texts, pieces in _slices([t or "" for t in batch["text"].to_pylist()]):
                if pieces:
                    ids = np.concatenate([own.encode([t])[0] for t in texts])
                    counts = np.array([len(ids)])
                else:
                    ids, counts = own.encode(texts)
                ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                columns = [batch["doc_id"].slice(row, len(counts)), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))]
                if decoded:
                    columns.append(pa.array(own.decode(ids, counts), pa.string()))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, lexicon: str) -> DataFrame:
    """``(doc_id, decoded)``: the text of each row's ids, special tokens included; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, lexicon)
        for batch in batches:
            column = batch["ids"]
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch([batch["doc_id"], pa.array(own.decode(ids, counts), pa.string())], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def encode_corpus(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """As ``encode``, with a lexicon of the most frequent words of ``docs`` itself."""
    lexicon = compile_lexicon(frequent_words(docs), path)
    return encode(docs, path, share_lexicon(docs.sparkSession, lexicon), decoded)


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
