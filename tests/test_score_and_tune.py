"""Scores, confusion, macro F1 and the threshold grid."""

from pyspark.sql import functions as F
from recordlens.operators import score, tune


def loop_f1(pairs):
    classes = {c for p in pairs for c in p}
    total = 0.0
    for c in classes:
        tp = sum(t == p == c for t, p in pairs)
        fp = sum(p == c != t for t, p in pairs)
        fn = sum(t == c != p for t, p in pairs)
        total += 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    return total / len(classes)


def test_fields(spark):
    truth = spark.createDataFrame(
        [("a", "emotional_tone", "upset"), ("a", "background_noise_type", "TV"), ("b", "emotional_tone", "neutral"), ("c", "emotional_tone", "neutral"), ("d", "emotional_tone", None)],
        "name string, field string, value string",
    )
    pred = spark.createDataFrame(
        [("a", "emotional_tone", "frustrated"), ("a", "background_noise_type", "television"), ("b", "emotional_tone", "distressed"), ("d", "emotional_tone", "upset"), ("e", "emotional_tone", "upset")],
        "name string, field string, value string",
    )
    found = score.judged(score.pairs(pred, truth))
    scores = {r["field"]: r for r in score.field_scores(found).collect()}
    assert scores["emotional_tone"]["n"] == 2 and scores["emotional_tone"]["accuracy"] == 0.0 and scores["emotional_tone"]["adjacent_accuracy"] == 0.5
    assert scores["background_noise_type"]["accuracy"] == 1.0 and scores["background_noise_type"]["partial_credit"] == 1.0
    assert score.confusion(found).count() == 2
    assert score.mean_field_accuracy(score.field_scores(found)).first()[0] == 0.5
    status = {r["name"]: r["status"] for r in score.name_status(pred, truth).collect()}
    assert status == {"a": "matched", "b": "matched", "d": "matched", "c": "missing_prediction", "e": "unlabelled"}


def test_macro_f1(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("c", "a"), ("d", "d")]
    found = spark.createDataFrame([(1, t, p) for t, p in pairs], "g int, truth string, pred string")
    assert abs(score.macro_f1(found, "g").first()["macro_f1"] - loop_f1(pairs)) < 1e-12


def test_grid(spark):
    rows = spark.createDataFrame([(g, float(x), "true" if x >= 12 else "false") for g in range(6) for x in (3, 9, 12, 15)], "grp int, silence double, truth string")
    decide = lambda v: F.when(F.col("silence") >= v, "true").otherwise("false")
    dealt = rows.join(tune.folds(rows, 3), "grp")
    mean = tune.grouped_mean(tune.grid_scores(dealt, [6.0, 12.0, 18.0], decide, "fold"))
    best = tune.best(mean, "mean_score").first()
    assert best["candidate"] == 12.0 and best["mean_score"] == 1.0 and best["folds"] == 3
