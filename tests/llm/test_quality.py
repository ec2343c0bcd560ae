"""Quality classifier: held-out accuracy and edge cases."""

import math
import zlib

import numpy as np
from recordlens.llm import quality

DIR = "/root/testdata/sf0.1"


def test_held_out(spark):
    found = quality.op2_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for h, i in zip(found["held_out"], found["doc_id"]))
    held = found[found["held_out"]]
    assert held["score"].between(0, 1).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.92
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98  # the normalised difference alone


def test_labels_are_no_input(spark):
    docs = spark.createDataFrame([(k, "plain words here " * 9 if k % 2 else "X!! Y!! Z!! " * 9, "a") for k in range(60)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    scorer = quality.fit(docs, labels)
    a = {r["doc_id"]: r["score"] for r in quality.score(docs, scorer).collect()}
    moved = docs.withColumn("doc_id", docs["doc_id"] + 1000)
    b = {r["doc_id"] - 1000: r["score"] for r in quality.score(moved, scorer).collect()}
    assert a == b and a[1] > 0.5 > a[0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "wörd " * 100_000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    scorer = quality.fit(docs, empty)
    found = quality.score(docs, scorer).collect()
    assert len(found) == 5 and {r["score"] for r in found} == {0.5}
    only_good = spark.createDataFrame([(k, 1) for k in range(10)] + [(None, 1), (99, None)], "doc_id long, quality int")
    assert all(r["score"] > 0.5 for r in quality.score(docs, quality.fit(docs, only_good)).collect())
    trained = quality.CompressionScorer(b"good words " * 50, b"BAD!! WORDS!! " * 50, weight=5.0)
    assert 0 <= trained.scores([None, "", "a"]).min() <= trained.scores([None, "", "a"]).max() <= 1
    assert quality.score(docs.limit(0), trained).count() == 0


def test_blocks_cover_the_text():
    raw = bytes(range(256)) * 40
    for block in (1, 128, 512, 99_999):
        assert b"".join(quality._blocks(raw, block)) == raw and max(map(len, quality._blocks(raw, block))) <= block
    assert quality._blocks(b"", 128) == []


def test_settings_are_chosen_by_training_rows():
    x, y = np.array([0.1, 0.4, 0.4, 0.9]), np.array([0, 0, 1, 1])
    assert quality.area_under_curve(x, y) == 0.875 and quality.area_under_curve(x[:1], y[:1]) == 0.5
    pairs = [(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]]
    assert quality.area_under_curve(x, y) == np.mean(pairs)


def test_held_out_labels_change_nothing(spark):
    """A scorer fitted with the held-out rows' labels turned over is the same in every part."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert vars(quality.fit(docs, labels)) == vars(quality.fit(docs, turned))


def test_piece_length():
    assert quality.piece_length([10, 20, 30], 1000) == 30 and quality.piece_length([10, 500, 500], 110) == 50
    assert quality.piece_length([], 10) == 0 and quality.piece_length([5, 5], 4) == 2


def plain_fit(rows, labels):
    """The same fit by hand: rows are (doc_id, text), in the order that the hash of doc_id gives them."""
    texts = {q: [text for i, text in rows if labels.get(i) == q] for q in (0, 1)}
    books, rest = {}, []
    for q, all_of in texts.items():
        part = quality.piece_length([len(t.encode()) for t in all_of[::2]])
        cuts = [(raw, zlib.crc32(raw) % max(1, len(raw) - part + 1)) for raw in (t.encode() for t in all_of[::2])]
        books[q] = b"".join(raw[at : at + part] for raw, at in cuts)
        rest += [(t, q) for t in all_of[1::2]]
    return books, rest


def test_fit_against_plain_version(spark):
    """Dictionaries hold a piece of every chosen text, and scores are those of a plain computation."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = quality.fit(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect()]
    books, rest = plain_fit(rows, known)
    assert scorer.good == books[1] and scorer.bad == books[0]
    size = lambda book, raw: sum(len(book.compress(raw[k : k + step])) for step in [math.ceil(len(raw) / math.ceil(len(raw) / scorer.block))] for k in range(0, len(raw), step))
    good, bad = scorer._compressors()
    for text, _ in rest[:200]:
        raw = text.encode()
        want = (size(bad, raw) - size(good, raw)) / len(raw) if raw else 0.0
        assert scorer.differences([text])[0] == want
        assert abs(scorer.scores([text])[0] - 1 / (1 + math.exp(-(want * scorer.weight + scorer.offset)))) < 1e-12


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * x - 1)))).astype(float)
    weight, offset = quality._logistic(x, y)
    assert abs(weight - 3) < 0.3 and abs(offset + 1) < 0.2


def test_repeated_ids_and_long_texts_in_the_fit(spark):
    rows = [(k, "plain words here " * 9 if k % 2 else "X!! Y!! Z!! " * 9) for k in range(40)] * 3 + [(41, "plain words " * 100_000), (None, "x"), (43, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(44)] + [(1, 1), (None, 0)], "doc_id long, quality int")
    scorer = quality.fit(docs, labels)
    assert scorer.scores(["plain words here " * 5])[0] > 0.5 > scorer.scores(["Y!! X!! Z!! " * 7])[0]


def test_keep_good_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "good words ok", 3.0, 1), (1, "good words ok", 3.0, 1), (None, None, None, 2)], "doc_id long, text string, score double, _quality int")
    scorer = quality.CompressionScorer(b"", b"", offset=1.0)
    assert quality.keep_good(docs, scorer).collect() == docs.collect()
    assert quality.keep_good(docs, quality.CompressionScorer(b"", b"", offset=-9.0)).count() == quality.keep_good(docs.limit(0), scorer).count() == 0
