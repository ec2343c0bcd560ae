"""Packing: pieces, places and ids against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from recordlens.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    tokenizer = Tokenizer.from_file(PATH)
    assert packing.reader(PATH).ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_special_and_long(library):
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "  \n\t " * 200, "a" + " " * 600_000 + "b", "\n" * 400_000, "é́ ß 中文 \U0001f600"):
        assert packing.reader(PATH).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(other).encode("Hello there", add_special_tokens=False).ids
    assert packing.reader(other).ids("Hello there").tolist() == want


@pytest.mark.parametrize("length, points", [(1, [0]), (8, [0]), (9, [0, 1]), (16, [0, 8]), (20, [0, 4, 12])])
def test_cut_points(length, points):
    assert packing.cut_points(length, 8) == points


def test_place_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 1025, 4000))[::-1]
    where, offset = packing.place(lengths)
    fill = np.zeros(where.max() + 1, int)
    for w, o, n in zip(where, offset, lengths):
        assert o == fill[w]
        fill[w] += n
    assert fill.max() <= 1024 and len(fill) <= np.ceil(lengths.sum() / 1024) * 1.01 + 1


def test_place_minimises_squares():
    # gaps 4, 4 and 5: an item of 2 leaves 1+1+1 from a gap of 4, but 4+1 from the gap of 5
    where, offset = packing.place(np.array([6, 6, 5, 2]), 10)
    assert where.tolist()[:3] == [0, 1, 2] and where[3] in (0, 1) and offset.tolist() == [0, 0, 0, 6]


def test_pack_documents(spark, library):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "thing", "naïve", "x1"]) for _ in range(draw.randrange(0, 900))) for _ in range(60)]
    texts += ["", None, "word " * 5000, texts[0], texts[0]]
    rows = [(k, t, "n", 0) for k, t in enumerate(texts)] + [(None, "null id", "n", 0), (3, texts[3], "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")
    for ids in (False, True):
        pieces = packing.tokenize(docs, PATH, ids=ids)
        packed = packing.pack(pieces, rows=50)
        found = packed.toPandas().sort_values(["sequence_id", "offset"])
        groups = found.groupby("sequence_id")
        assert (found["offset"] == groups["length"].cumsum() - found["length"]).all() and groups["length"].sum().max() <= 1024
        assert len(found) == pieces.count() and found["doc_id"].isna().sum() == 1
        for k in (0, 5, 60, 61, 62):
            want = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
            own = found[found["doc_id"] == k].sort_values("piece")
            assert own["length"].sum() == len(want) and list(own["length"][1:]) == [1024] * (len(own) - 1)
            for p in own.itertuples():
                assert p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], "<u4").tobytes())
        if ids:
            assert packing.sequences(packed).selectExpr("max(size(ids)) AS n").first()["n"] <= 1024


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0
