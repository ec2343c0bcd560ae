"""Vocabulary, class votes, roles and emotion."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from recordlens.functions import vocab
from recordlens.operators import classdist, clusters, emotion, roles


def one(spark, column, *values):
    row = spark.range(1).select(column(*[F.lit(v) for v in values]).alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    "text, term",
    [("TV", "television"), ("sharp static", "static"), ("hiss", "static"), ("loud TV", "television"), ("Babble", "office chatter"), ("keyboard", "keyboard typing"),
     ("faint hum", "hum"), ("background voices", "office chatter"), ("", ""), ("Wind noise (microphone)", "wind"), ("Sine wave", "sine wave"), ("some", "some")],
)
def test_normalize(spark, text, term):
    assert one(spark, vocab.normalize, text) == term


def test_match(spark):
    like = lambda a, b: one(spark, vocab.match, a, b)
    assert like("TV", "television") == 1.0 and like("", "static") == 0.0 and like("", "") == 1.0
    assert like("road noise", "crowd noise") == 0.5 and like("traffic", "hum") == 0.5 and like("music", "wind") == 0.0
    assert like("hum", "traffic") == like("traffic", "hum")


def test_votes(spark):
    scores = spark.createDataFrame(
        [(1, "Car", 0.2), (1, "Engine", 0.2), (1, "Vehicle", 0.2), (1, "Music", 0.45), (2, "Speech", 0.9), (2, "Dial tone", 0.5), (2, "Radio", 0.07),
         (3, "Sine wave", 0.9), (3, "Telephone bell ringing", 0.5)], "file_id long, name string, score double",
    )
    votes = classdist.class_votes(scores)
    best = {r["file_id"]: (r["term"], round(r["score"], 6)) for r in classdist.ranked(votes, "score", 1).collect()}
    assert best == {1: ("road noise", 0.6), 2: ("television", 0.07)}
    held = {r["file_id"]: r["noise_class_dist"] for r in classdist.as_map(classdist.shares(votes)).collect()}
    assert abs(sum(held[1].values()) - 1.0) < 1e-9


def test_signature(spark):
    shape = spark.createDataFrame([(1, 0.95, 0.1, 0.5, 0.0), (2, 0.1, 0.9, 0.0, 0.5)], "file_id long, flatness double, low_share double, high_share double, hum_share double")
    found = classdist.spectral_signature(shape)
    assert sorted((r["file_id"], r["term"]) for r in found.collect()) == [(1, "static"), (2, "hum"), (2, "road noise")]
    votes = spark.createDataFrame([(1, "static", 0.2)], "file_id long, term string, score double")
    assert {(r["file_id"], r["term"]): round(r["score"], 3) for r in classdist.add_signature(votes, found).collect()}[(1, "static")] == 0.6


def test_role_patterns(spark):
    votes = lambda text: one(spark, roles.agent_votes, text)
    assert votes("Thank you for calling, how can I help?") == 2.0
    assert votes("I've been waiting, this is ridiculous") == -2.0
    assert votes("hello") == 0.0


def test_acoustic_roles(spark):
    clusters = spark.createDataFrame(
        [(1, 0, -60.0, 2.0, 0.0, 0.0), (1, 1, -40.0, 8.0, 3.0, 0.0), (2, 0, -50.0, 3.0, 0.0, 3.0), (2, 1, -50.0, 3.0, 1.0, 0.0), (3, 0, -50.0, 3.0, 0.0, 0.0)],
        "file_id long, cluster int, floor_db double, level_sd double, first_start_s double, votes double",
    )
    best = {r["file_id"]: (r["cluster"], round(r["role_confidence"], 4)) for r in roles.acoustic_roles(clusters).where("rank = 1").collect()}
    assert best[1] == (1, 1.0) and best[2][0] == 1 and best[3] == (0, roles.ONE_SPEAKER)
    lexical = roles.lexical_roles(clusters).collect()
    assert [(r["file_id"], r["customer"], r["role_confidence"]) for r in lexical] == [(2, 1, 0.75)]


def test_emotion(spark):
    posteriors = spark.createDataFrame([(1, "ang", 1.0), (2, "neu", 0.5), (2, "hap", 0.5)], "file_id long, label string, p double")
    found = {r["file_id"]: (round(r["valence"], 4), round(r["arousal"], 4)) for r in emotion.project(posteriors).collect()}
    assert found == {1: (-0.7, 0.7), 2: (0.35, -0.35)}
    rows = spark.createDataFrame([(1, 0.5, -0.4, 0.2), (2, 0.0, 0.9, None), (3, 0.0, None, None)], "file_id long, arousal double, acoustic double, role_confidence double")
    words = spark.createDataFrame([(1, 0.8), (2, -0.9), (3, -0.5)], "file_id long, lexical double")
    out = {r["file_id"]: (round(r["valence"], 4), r["valence_source"]) for r in emotion.cascade(rows, words).collect()}
    assert out == {1: (round((0.35 * -0.4 + 0.65 * 0.8) * 0.7, 4), "fused"), 2: (0.9, "acoustic"), 3: (-0.5, "lexical")}


def test_two_means(spark):
    """Against all ways to split eleven vectors."""
    rng = np.random.default_rng(4)
    held = {}
    for spread in (0.2, 1.0):
        x = np.concatenate([rng.normal([1, 0, 0], spread, (5, 3)), rng.normal([0, 1, 0], spread, (6, 3))])
        held[spread] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(spread, i, v.tolist()) for spread, x in held.items() for i, v in enumerate(x)]
    found = {}
    for r in clusters.two_means(spark.createDataFrame(rows, "file_id double, id long, embedding array<double>")).collect():
        found.setdefault(r["file_id"], {})[r["id"]] = r["cluster"]
    for spread, x in held.items():

        def worth(label, x=x):
            return sum(np.linalg.norm(x[np.array(label) == k].sum(axis=0)) for k in (0, 1))

        best = max(worth(c) for c in itertools.product((0, 1), repeat=len(x)))
        assert worth([found[spread][i] for i in range(len(x))]) >= best - (1e-9 if spread < 1 else 0.15)


def test_speakers(spark):
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal([1, 0, 0, 0], 0.1, (10, 4)), rng.normal([0, 1, 0, 0], 0.1, (10, 4))])
    one = rng.normal([1, 1, 0, 0], 0.02, (12, 4))
    lone = np.concatenate([rng.normal([1, 0, 0, 0], 0.05, (19, 4)), [[0.0, 0.0, 1.0, 0.0]]])
    rows = [(f, i, v.tolist()) for f, x in (("two", two), ("one", one), ("lone", lone)) for i, v in enumerate(x)]
    found = {}
    for r in clusters.speakers(spark.createDataFrame(rows, "file_id string, id long, embedding array<double>")).collect():
        found.setdefault(r["file_id"], {})[r["id"]] = r["cluster"]
    assert found["two"] == {i: int(i >= 10) for i in range(20)}
    assert set(found["one"].values()) == {0} and set(found["lone"].values()) == {0}
