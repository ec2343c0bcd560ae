"""Hard negatives against a plain version that multiplies everything at once."""

import duckdb
import numpy as np
import pytest
from recordlens.llm import negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    used = []
    for k, (vec_id, vec, label) in enumerate(rows):
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((k, vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in vec], label))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    for k, vec_id, q, label in used:
        if vec_id is None or vec_id % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, other)), i, n, lab) for n, i, other, lab in used if n != k and len(other) == len(q)]
        for ps, positive, _, _ in sorted((s for s in scored if s[3] == label), key=key)[:5]:
            fits = sorted((s for s in scored if s[3] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)[:3]
            out += [(vec_id, positive, n + 1, i, ps, s) for n, (s, i, _, _) in enumerate(fits)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, rows, more=""):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, row string")


def near_rows(seed, size, dims):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dims))
    rows = [(k, (centres[k % 4] + 0.6 * rng.standard_normal(dims)).tolist(), int(rng.integers(0, 3))) for k in range(size)]
    return rows


@pytest.mark.parametrize("tile", [(256, 1024, 32), (2, 7, 3)])
def test_same_as_plain(spark, monkeypatch, tile):
    for name, value in zip(("ANCHORS", "ROWS", "CHUNK"), tile):
        monkeypatch.setattr(negatives, name, value)
    rows = near_rows(1, 160, 8)
    rows += [(50, rows[0][1], 0), (50, rows[0][1], 0), (7, rows[3][1], 9), (None, rows[0][1], 0), (None, rows[1][1], 1), (150, None, 1), (200, rows[1][1], None)]
    rows += [(250, [1.0, None] * 4, 1), (300, [1.0, float("nan")] * 4, 1), (350, [float("inf")] * 8, 0), (400, [0.0] * 8, 2), (450, [1.0, 2.0], 1), (451, [1.0, 1.5], 1), (452, [0.5, 1.0], 2)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(30)] + [(500, [], 1), (501, [], 1), (502, [], 2)]
    got = found(negatives.hard_negatives(made(spark, rows).repartition(3)))
    assert got == plain(rows) and len(got) > 20


def test_hot_label_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    rows = [(k, [1.0, 0.5, 0.25], 1) for k in range(300)] + [(300 + k, [0.5, 0.5, 0.25], 2) for k in range(100)]
    assert found(negatives.hard_negatives(made(spark, rows))) == plain(rows)


def test_too_large_is_an_error():
    with pytest.raises(ValueError):
        negatives.partial_tile(np.full((1, 2), 2**30), np.full((1, 2), 2**30))
    assert negatives.partial_tile(np.array([[2**25, 3]]), np.array([[2**25, -1], [0, 7]])).tolist() == [[2**50 - 3, 21]]


def test_empty_table(spark):
    assert negatives.hard_negatives(made(spark, [])).count() == 0
    assert negatives.hard_negatives(made(spark, [(50, [1.0], 1)])).count() == 0


def test_query_and_sql(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = found(negatives.op13_summa_negatives(spark, path))
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert sorted(con.execute(negatives.OP13_SQL).fetchall(), key=str) == got


def test_scores_stay_in_their_tasks(spark, monkeypatch):
    """What is shuffled grows with the rows, not with the products of anchors and rows; many panels give the same result."""
    shuffled = []
    whole = negatives.best_rows
    monkeypatch.setattr(negatives, "best_rows", lambda left, right, *more: shuffled.append(whole(left, right, *more)) or shuffled[-1])
    rows = near_rows(3, 1200, 8) + [(50 * k, [float(k % 7)] * 8, k % 3) for k in range(24, 60)]
    once = found(negatives.hard_negatives(made(spark, rows)))
    for name, value in (("PANEL_CELLS", 8 * 16), ("PANEL_ROWS", 100), ("PANELS", 5), ("ANCHORS", 5), ("ROWS", 30)):
        monkeypatch.setattr(negatives, name, value)
    assert found(negatives.hard_negatives(made(spark, rows))) == once == plain(rows)
    for part in shuffled:
        assert part.count() <= 15 * 5 * len({r[0] for r in rows if r[0] % 50 == 0})  # of each anchor a window's best of each panel of rows
