"""The corpus pipeline, stage by stage against plain versions, and as a whole."""

import glob
import hashlib
from itertools import combinations
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from recordlens.llm import common, lines, quality, simhash
from recordlens.llm.common import least_labels

DIR = "/root/testdata/sf0.001"


def plain_line_dedup(rows):
    """By the operator's SQL: n_dropped and the hash of what is kept, of which the text is any subset of lines."""
    documents = pd.DataFrame({"doc_id": list(rows), "text": list(rows.values())})  # noqa: F841  read by the SQL
    found = {r[0]: (r[2], r[3]) for r in duckdb.sql(lines.OP3_SQL).fetchall()}
    recur = {}
    for i, text in rows.items():
        n, digest = found[i]
        own = text.split("\n")
        if not n:
            recur[i] = text
            continue
        for gone in combinations(range(len(own)), n):  # small texts lose few lines
            left = "\n".join(line for k, line in enumerate(own) if k not in gone)
            if hashlib.sha256(left.encode()).hexdigest() == digest:
                recur[i] = left
                break
    return recur


def plain_substring_dedup(rows):
    """Kept words of each document: a word goes if a window of 20 words over it starts earlier elsewhere."""
    first, words = {}, {i: (t or "").split() for i, t in rows.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][k : k + 20]), (i, k))
    out = {}
    for i, own in words.items():
        gone = {k + j for k in range(len(own) - 19) if first[tuple(own[k : k + 20])] != (i, k) for j in range(20)}
        out[i] = [w for k, w in enumerate(own) if k not in gone]
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "best_fit_packing":
            assert out.columns == names
            kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_classifier":
            scorer = quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            ids = list(rows)
            assert set(kept) == {i for i, s in zip(ids, scorer.scores([rows[i] for i in ids])) if s >= quality.THRESHOLD}
        elif name == "line_dedup":
            assert kept == plain_line_dedup(rows)
            assert all(set(kept[i].split("\n")) <= set(rows[i].split("\n")) | {""} for i in rows)
        elif name == "simhash_near_dedup":
            ids = sorted(rows)
            fps = np.array([simhash.fingerprint(rows[i]) for i in ids], np.uint64)
            i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
            assert set(kept) == {ids[k] for k in set(least_labels(i, j, len(ids)).tolist())}
        elif name == "substring_dedup":
            assert {i: (t or "").split() for i, t in kept.items()} == plain_substring_dedup(rows)
        else:
            found = out.toPandas()
            assert set(found["doc_id"]) == set(rows) and found.groupby("sequence_id")["length"].sum().max() <= 1024
        seen[name] = out.count()
        docs = out
    assert len(seen) == 5


def test_run(spark):
    found = corpus_pipeline.run(spark, DIR).toPandas()
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(found.columns) and len(found) > 50


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass through every stage; so does an empty table."""
    long = "word another third " * 20_000
    rows = [(1, "a plain text of some words", "x", 7), (1, "a plain text of some words", "x", 7), (None, None, None, None), (2, "", "y", 1), (3, long, "z", 2), (4, "one two three", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, spans int").withColumn("n_chars", F.length("text").cast("long")).withColumn("packed", F.lit(1))
    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(labels))
    for table in (docs, docs.limit(0)):
        held = table
        for name, stage in corpus_pipeline.STAGES:
            held = stage(spark, held, str(tmp_path))
            if name != "best_fit_packing":
                assert held.columns == docs.columns
                assert held.where("doc_id = 1").count() == (2 if table is docs else 0)
                wrong = held.where(~F.col("n_chars").eqNullSafe(F.length("text")))
                assert wrong.count() == 0
        assert held.where("doc_id = 4").count() == (1 if table is docs else 0)


def test_run_leaves_one_stage_folder(spark):
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/pipeline-*/*"))
    corpus_pipeline.run(spark, DIR)
    assert [p.rsplit("/", 1)[1] for p in set(glob.glob(f"{folder}/pipeline-*/*")) - before] == ["3-substring_dedup"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=Context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(session)
