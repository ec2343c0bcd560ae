"""Embedding near-duplicates against a comparison of all pairs."""

import numpy as np
import pytest
from recordlens.llm import nndescent
from recordlens.llm.common import least_labels

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    usable = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    i, j = [], []
    for a in usable:
        for b in usable:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(np.float32(rows[a][1])), np.float64(np.float32(rows[b][1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    i.append(a), j.append(b)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    label = least_labels(place[np.array(i, int)], place[np.array(j, int)], len(ids))
    links = np.bincount(np.array(i, int), minlength=len(ids))
    return {ids[k]: (int(links[k]), ids[order[label[place[k]]]]) for k in range(len(ids))}


def groups(seed, n=600, dims=16):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(dims).tolist(), int(rng.integers(3))) for k in range(n)]
    for k in range(n, n + 60):  # near copies of a few
        base = rows[int(rng.integers(20))]
        rows.append((k, (np.array(base[1]) + 0.15 * rng.standard_normal(dims)).tolist(), base[2]))
    for k in range(n + 60, n + 200):  # one dense group
        rows.append((k, (np.array(rows[0][1]) + 0.1 * rng.standard_normal(dims)).tolist(), rows[0][2]))
    return rows + [(n + 200 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    rows = groups(seed)
    want = brute(rows)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [None, 1.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 3), (14, [0.0, 1.0], 3),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_links string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nndescent.near_duplicates(df).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[10] == (2, 1, False) and found[14] == (1, 13, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 11, 12):
        assert found[k] == (0, k, True)
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)], SCHEMA)
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(twice).collect()) == [("1", 2, 1), ("1", 2, 1), ("None", 2, 1)]


def test_clumps_that_fill_their_lists(spark):
    rng = np.random.default_rng(3)
    across = np.zeros((2, 64))
    across[:, 0], across[1, 1] = 1.0, 0.32  # cosine 0.952
    rows = [(k, (across[k % 2] + 0.004 * rng.standard_normal(64)).tolist(), 1) for k in range(100)]
    rows += [(100 + k, (-across[1] + 0.004 * rng.standard_normal(64)).tolist(), 1) for k in range(20)]  # links with none of them
    want = brute(rows)
    assert want[0] == (99, 0) and want[100] == (19, 100)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want


def test_lists_that_miss_links(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "neighbour_graph", lambda *_: spark.createDataFrame([], "u long, v long, sim double"))
    rows = groups(0)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def isolated_pairs(size, pairs, dims=64, seed=7):
    """Vectors of one label, of which some pairs at a cosine of 0.932 to 0.95 are the only links."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((size, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        away = rng.standard_normal(dims)
        away -= (away @ x[2 * k]) * x[2 * k]
        cosine = rng.uniform(0.932, 0.95)
        x[2 * k + 1] = cosine * x[2 * k] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    return x


def test_isolated_pairs_are_found_whatever_the_number_of_vectors(spark):
    x = isolated_pairs(60_000, 150)
    order = np.random.default_rng(1).permutation(len(x))
    rows = spark.createDataFrame(((int(k), x[k].tolist(), 1) for k in order), SCHEMA)
    found = nndescent.near_duplicates(rows).where("n_links > 0").collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(k, 1, k - k % 2) for k in range(300)}


def test_tables_needed():
    for bits in (0, 3, 8, 12, 20):
        n, shared = nndescent.tables_needed(bits, 0.93), (1 - np.arccos(0.93) / np.pi) ** bits
        assert n >= nndescent.TABLES and (1 - shared) ** n <= nndescent.MISSED * 1.0001
    assert nndescent.tables_needed(8, 0.93) < 25


def test_audit_sees_links_that_a_plain_sample_misses(spark, monkeypatch):
    """Of 3,000 vectors two are linked: the sample has them, and without any link there is nothing to audit."""
    monkeypatch.setattr(nndescent, "AUDIT", 8)
    x = isolated_pairs(3000, 1)
    nodes = spark.createDataFrame([(k, 1, x[k].tolist(), 1) for k in range(3000)], "id long, label long, vec array<double>, copies long")
    start, halves = nndescent.start_graph(nodes, 8, 0.93)
    linked = start.where("sim >= 0.93").selectExpr("u AS id")
    wanted = nndescent.sampled_links(nodes, linked, 0.93)
    assert {r["u"] for r in wanted.collect()} == {0, 1} and nndescent.found_share(halves) > 0.9
    assert nndescent.audit(start, wanted, 0.93, 8) == 1.0 and nndescent.audit(start.limit(0), wanted, 0.93, 8) == 0.0
    none = nndescent.sampled_links(nodes.where("id > 1"), linked.limit(0), 0.93)
    assert none.count() == 0 and nndescent.audit(start, none, 0.93, 8) is None and nndescent.found_share(halves.limit(0)) is None
    assert nndescent.final_audit(spark.createDataFrame([], "u long, links long"), none) is None


def test_full_lists_are_doubled(spark):
    """A group of 40 near copies needs lists of 39, and no tiles."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    x = np.concatenate([rng.standard_normal((400, 64)), base + 0.02 * rng.standard_normal((40, 64))])
    nodes = spark.createDataFrame([(k, 1, v.tolist(), 1) for k, v in enumerate(x)], "id long, label long, vec array<double>, copies long")
    start, halves = nndescent.start_graph(nodes, 8, 0.93)
    assert nndescent.found_share(halves) is None  # full lists say nothing about the tables
    graph, size = nndescent.enlarged(nndescent.refine(start, nodes, 8), nodes, 0.93, nodes.selectExpr("id AS u"))
    near = graph.where("sim >= 0.93").groupBy("u").count().collect()
    assert size == 64 and {(r["u"], r["count"]) for r in near} == {(k, 39) for k in range(400, 440)}
