"""Substring deduplication against a search of every window."""

import random

import pytest
from recordlens.llm import relz


def brute(rows, window=20):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    rank = lambda d: (d is not None, d or 0)
    first = {}
    for d, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, ((True, 1 << 62), 0)), (rank(d), s))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (rank(d), s):
                gone[s : s + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = relz.remove_repeats(docs, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], b" ".join((r["text"] or "").encode().split()).decode()) for r in out), key=str)


def prose(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_random_mixtures(spark, seed):
    draw = random.Random(seed)
    shared = [prose(draw, draw.choice([19, 20, 21, 35, 80])) for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(draw.randrange(0, 6)):
            words += draw.choice(shared) if draw.random() < 0.6 else prose(draw, draw.randrange(1, 50))
        rows.append((k, " ".join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, " ".join(["again"] * 90)), (63, " ".join(["a", "b"] * 40))]
    assert run(spark, rows) == brute(rows)


def test_many_contexts_of_one_passage(spark):
    draw = random.Random(9)
    line = " ".join(prose(draw, 20))
    rows = [(k, " ".join(prose(draw, 12, 9000)) + " " + line + " " + " ".join(prose(draw, 12, 9000))) for k in range(80)]
    found = run(spark, rows)
    assert found == brute(rows) and sum(r[2] for r in found) == 79 * 20


def test_small_vocabulary(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(prose(draw, 120, 2))) for k in range(12)]
    assert run(spark, rows, window=8, phrase=3) == brute(rows, 8)


def test_edges(spark):
    draw = random.Random(4)
    text = " ".join(prose(draw, 30))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " \t\n "), (5, text.replace(" ", "\r\n\t")), (6, "é x " * 25), (7, " ".join(prose(draw, 5)))]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(1, "keep  my\nspaces", "mine", "x")], "doc_id long, text string, n_removed string, spans string")
    row = relz.remove_repeats(docs).first()
    assert row["text"] == "keep  my\nspaces" and row["n_removed"] == 0 and row["n_words"] == 3
    assert relz.remove_repeats(docs.limit(0)).count() == 0


def test_very_long(spark):
    draw = random.Random(8)
    words = prose(draw, 150_000, 50_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[70_000:70_400])), (3, " ".join(words))]
    found = {r[0]: r[2] for r in run(spark, rows)}
    assert found == {1: 0, 2: 400, 3: 150_000}
