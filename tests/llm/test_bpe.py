"""Byte-level BPE against tiktoken, and round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from recordlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, text):
    coder = bpe.coder(PATH, public_tokenizers.PATTERN)
    ids = coder.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_newer_characters(reference):
    coder = bpe.coder(PATH, public_tokenizers.PATTERN)
    for text in ("ꇏ\xd5槅領\U00010cec℩\U00018eb4뮀", "a\U00018eb4b ࢏1", "<|endoftext|>", "x" * 3000, " 　\u0085\x1c\x1f a", "'s'LL"):
        assert coder.encode(text).tolist() == reference.encode_ordinary(text)


def test_cache_turns_over(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    coder = bpe.ByteBpe(PATH, public_tokenizers.PATTERN)
    for k in range(20):
        text = " ".join(f"word{k}x{n}" for n in range(30))
        assert coder.encode(text).tolist() == reference.encode_ordinary(text) and len(coder.known) < 200


def test_rank_file_must_hold_all_bytes(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no rank"):
        bpe.ByteBpe(str(path), public_tokenizers.PATTERN)


def test_rows(spark, reference):
    texts = [None, "", "Hello, wörld!", "Hello, wörld!", "long " * 100_000]
    docs = spark.createDataFrame([(k if k else None, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH).cache()
    assert coded.count() == 5
    found = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for k, text in enumerate(texts):
        assert found[k or None] == reference.encode_ordinary(text or "")
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded, PATH).collect()}
    assert all(back[k or None] == (t or "").encode() for k, t in enumerate(texts))
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nothing, PATH).first()["decoded"]) == b""


def test_query(spark, reference):
    path = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in bpe.op10_byte_bpe(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = reference.encode_ordinary(r["text"] or "")
        row = found[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert isinstance(np.array(found[0]["n_tokens"]).item(), int)
