"""SimHash: fingerprints and groups against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from recordlens.llm import simhash
from recordlens.llm.common import connected_components, least_labels


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  ", "A", "a b", "A b\tC", "ÀB c\x0bd É f", "x " * 500, "One two three four FIVE one two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def test_fingerprint_pieces():
    text = " ".join(f"w{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(text) == slow(text)


def components(fps, radius=3):
    u = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius)
    return least_labels(i, j, len(u))


@pytest.mark.parametrize("tile", [4, 64, 4096])
def test_links(spark, tile):
    draw = random.Random(tile)
    base = [draw.getrandbits(64) for _ in range(150)]
    fps = list(dict.fromkeys([*base, *(base[k % 9] ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5))) for k in range(350)), 0, (1 << 64) - 1]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, tile)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = components(fps)
    groups = {}
    for k, root in enumerate(want):
        groups.setdefault(root, set()).add(signed[k])
    for members in groups.values():
        roots = {found.get(x, x) for x in members}
        assert roots == {min(members)}


def test_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows.sort()
    fps = [slow(t) for _, t in rows]
    root = components(fps)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash(spark, path).collect()}
    assert found == {d: (f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, root)}


def test_edges(spark):
    rows = [(5, None), (3, ""), (3, ""), (None, " "), (9, "some words that stand alone here"), (7, "w " * 300_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 9), (7, 7)], key=str)
    assert sorted((str(r["doc_id"]) for r in simhash.keep_one(docs).collect())) == ["3", "3", "7", "9"]  # the null id's text is that of 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(100)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    i, j = np.array(edges).T
    want = least_labels(i, j, 2200)
    assert found == {int(n): int(want[n]) for e in edges if e[0] != e[1] for n in e}
    none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert connected_components(none).count() == 0


def test_keep_one_by_row(spark):
    b, a, long = "one two three four five six", "seven eight nine ten eleven twelve", "x1 x2 x3 x4 " * 50_000
    rows = [(3, b, 1), (5, b, 2), (5, a, 3), (7, a, 4), (None, a, 5), (8, long, 6), (8, long, 7), (9, long, 8), (10, None, 9), (11, "", 10), (None, "only here now", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumn("fp", F.lit("mine"))
    kept = simhash.keep_one(docs)
    assert sorted(r["mark"] for r in kept.collect()) == [1, 3, 6, 7, 9, 11] and kept.columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0
