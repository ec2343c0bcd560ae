"""Ranked search against a plain version that scores every document."""

import random
import re
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from recordlens.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    held = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 25 + (75 * sum(c.values()) * held) // max(1, total)
            score = sum(floor(1000 * log((2 * held + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if lacks else doc, -score) for k, (score, lacks, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for t in ranking.terms_of(text)] == terms(text)


def test_pieces_end_outside_of_terms(monkeypatch):
    monkeypatch.setattr(ranking, "SLICE", 10)
    texts = ["ab cd ef gh ij kl", None, "", "x" * 300 + " y", "naïve é" * 5]
    held = {}
    for rows, parts in ranking._pieces(texts):
        for row, part in zip(rows.tolist(), parts):
            held.setdefault(row, []).append(part.decode())
    assert {k: "".join(v) for k, v in held.items()} == {k: t for k, t in enumerate(texts) if t}
    assert all([t for part in held[k] for t in terms(part)] == terms(texts[k]) for k in held) and len(held[0]) > 1


def test_bytes_bound_the_exact_impact():
    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 400, 5000), rng.integers(1, 30_000, 5000)
    exact = ranking.exact_impacts(tf, n, ranking.Statistics(100, 40_000, np.zeros(0)))
    steps = -(-exact * ranking.STEPS // ranking.LARGEST)
    assert steps.max() <= 255 and (steps * ranking.LARGEST >= exact * ranking.STEPS).all() and ((steps - 1) * ranking.LARGEST < exact * ranking.STEPS).all()


def corpus(seed, size):
    draw = random.Random(seed)
    words = ["the", "The", "naïve", "中文", "x1", "a", "b", "c"] + [f"w{k}" for k in range(60)]
    weights = [30, 10, 5, 3, 3, 20, 10, 10] + [1] * 60
    texts = [" ".join(draw.choices(words, weights, k=draw.randrange(0, 40))) for _ in range(size)]
    texts += [texts[0]] * 25 + [None, "", "...", "w1 " * 5000, "w2-w3_w4"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, "w1 w2")]


@pytest.mark.parametrize("rows, top", [(10_000, 10), (7, 3)])
def test_same_as_plain(spark, monkeypatch, rows, top):
    monkeypatch.setattr(ranking, "ROWS", rows)
    docs = corpus(rows, 150)
    items = [(0, "the naïve w1"), (1, "w1 w1 W2, w3"), (2, None), (3, "unknown"), (4, docs[0][1]), (4, docs[5][1]), (None, "中文 a b")]
    texts = spark.createDataFrame([(d, t, 1.5, "q") for d, t in docs], "doc_id long, text string, n double, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    assert found(ranking.top_documents(texts, asked, top)) == plain(docs, items, top)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_CHARS", 20)
    docs = corpus(5, 40)
    items = [(k, f"w{k} the w{k + 1} b") for k in range(12)]
    out = ranking.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert found(out) == plain(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.top_documents(none, items).count() == 0
    assert ranking.top_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert found(ranking.top_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items)) == plain([(1, "a")], [(1, "a")])


def test_query_and_sql(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()
    out = found(ranking.op12_quantised_search(spark, path))
    assert out == plain([tuple(r) for r in docs], [tuple(r) for r in items])
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    assert sorted(con.execute(ranking.OP12_SQL).fetchall(), key=str) == out
