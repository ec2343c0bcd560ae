"""The transducer lexicon against a dictionary, and its coder against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from recordlens.llm import transducer
from recordlens.llm.lexicon import Lexicon, minimal_automaton, ragged
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [" the", "the", " there", "there", "'s", " naïve", "naïve", "\n", " 12", "!", " Hello", "Hello", " .", "  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    place = tmp_path_factory.mktemp("lexicon") / "words.bin"
    place.write_bytes(transducer.compile_lexicon(WORDS, PATH).to_bytes())
    return transducer.Coder(transducer.merges(PATH), Lexicon.mapped(str(place)))


def ids_of(coder, texts):
    ids, counts = coder.encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_lexicon_numbers_words(words, others):
    words = sorted(words)
    lexicon = Lexicon.compile(words)
    asked = words + others
    raw = np.frombuffer(b"".join(asked), np.uint8)
    length = np.array([len(w) for w in asked], np.int64)
    start = np.cumsum(length) - length
    want = [words.index(w) if w in words else -1 for w in asked]
    assert lexicon.find(raw, start, length).tolist() == want


def test_suffixes_are_shared():
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"ed", b"ing", b"s"))
    arcs, _ = minimal_automaton(words)
    assert sum(map(len, arcs)) == 4 + 4 + 3 + 6 - 2  # wal- and tal- meet, and all endings are one
    with pytest.raises(ValueError):
        minimal_automaton([b"b", b"a"])


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" 'stmdrevl\n\tA1.é　", max_size=20)), min_size=1, max_size=5))
def test_any_texts(coder, library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(coder, texts) == want
    assert coder.decode(*coder.encode(texts)) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_character(coder, library):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"a{chr(c)}1" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings(coder, library):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "", " <|endoftext|> ", "plain"]
    assert ids_of(coder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.decode(*coder.encode(texts)) == texts
    assert coder.decode(np.array([168]), np.array([1])) == [library.decode([168])]


def test_rows(spark, library, monkeypatch):
    monkeypatch.setattr(transducer, "SLICE", 5000)
    draw = random.Random(1)
    long = " ".join(draw.choice(["the", "naïve", "x1", "<|endoftext|>", "it's", "\n\n"]) for _ in range(20_000))
    texts = [None, "", "Hello, wörld!", "Hello, wörld!", long, "x" * 30_000, " " * 20_000 + "b", long[:3000]]
    docs = spark.createDataFrame([(k if k else None, t, "mine", 3) for k, t in enumerate(texts)], "doc_id long, text string, ids string, word int")
    coded = transducer.encode_corpus(docs, PATH, decoded=True).cache()
    assert coded.count() == len(texts)
    for r in coded.collect():
        text = texts[r["doc_id"] or 0] or ""
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text
    assert transducer.encode_corpus(docs.limit(0), PATH).count() == 0
    name = transducer.share_lexicon(spark, transducer.compile_lexicon([], PATH))
    nothing = spark.createDataFrame([(1, None), (2, [50256, 72])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in transducer.decode(nothing, PATH, name).orderBy("doc_id").collect()] == ["", "<|endoftext|>i"]


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a b b b",), (None,), ("c b a",), ("x",)], "text string")
    assert transducer.frequent_words(docs, 2) == [" b"] and transducer.frequent_words(docs.limit(0)) == []


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        transducer.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    path = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in transducer.op11_transducer_bpe(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        row = found[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
