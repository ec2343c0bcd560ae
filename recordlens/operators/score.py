"""Scores of predictions against labels, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.vocab import match_terms, normalize
from recordlens.schema import FREE_TEXT, RANKS


def unpivot(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(name, field, value): each row's fields as strings, one row a field."""
    items = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    return df.select(F.col(key).alias("name"), F.explode(items).alias("x")).select("name", "x.field", "x.value")


def pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(name, field, truth, pred) of names in both; fields that the truth lacks are left out.

    A field that the prediction lacks has a null prediction, which counts as wrong.
    """
    known = predicted.select("name").distinct()
    given = truth.where(F.col("value").isNotNull()).join(known, "name", "left_semi").withColumnRenamed("value", "truth")
    return given.join(predicted.withColumnRenamed("value", "pred"), ["name", "field"], "left")


def _rank(field: Column, value: Column, ranks: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("long")
    for name, order in ranks.items():
        out = F.when(field == name, F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0))).otherwise(out)
    return out


def judged(found: DataFrame, ranks: dict[str, tuple[str, ...]] = RANKS, free: tuple[str, ...] = FREE_TEXT) -> DataFrame:
    """``pairs`` with hit, adjacent and partial; free text is compared by its terms."""
    text = F.col("field").isin(*free) if free else F.lit(False)
    term = lambda c: F.when(text, normalize(F.col(c))).otherwise(F.col(c))
    seen = found.withColumns({"truth": term("truth"), "pred": term("pred")})
    like = match_terms(F.coalesce("truth", F.lit("")), F.coalesce("pred", F.lit("")))
    hit = F.when(text, like >= 1.0).otherwise(F.coalesce(F.col("truth") == F.col("pred"), F.lit(False)))
    near = F.abs(_rank(F.col("field"), F.col("truth"), ranks) - _rank(F.col("field"), F.col("pred"), ranks)) <= 1
    ordinal = F.col("field").isin(*ranks)
    return seen.withColumn("hit", hit).withColumns(
        {"adjacent": F.when(ordinal, F.coalesce(near, F.lit(False))).otherwise(F.col("hit")), "partial": F.when(text, like)}
    )


def _class_counts(found: DataFrame, keys: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """tp, fp and fn of each class by ``keys``, and ``sums`` of the pairs, added at the class of their truth.

    Pairs are counted by (truth, pred) before they are shuffled.
    """
    counts = found.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    n, none, hit = F.col("n"), F.lit(0).cast("long"), F.col("truth").eqNullSafe(F.col("pred"))
    missed = F.when(hit, none).otherwise(n)

    def side(of: str, tp: Column, fp: Column, fn: Column, own: bool) -> Column:
        carried = [(F.col(name) if own else F.lit(None)).cast(counts.schema[name].dataType).alias(name) for name in sums]
        return F.struct(F.col(of).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *carried)

    sides = counts.select(*keys, F.explode(F.array(side("truth", n - missed, none, missed, True), side("pred", none, missed, none, False))).alias("x"))
    return sides.groupBy(*keys, F.col("x.class").alias("class")).agg(*[F.sum(f"x.{name}").alias(name) for name in ("tp", "fp", "fn", *sums)])


def _mean_f1() -> Column:
    """Mean F1 over rows of tp, fp and fn; an F1 that is undefined is 0."""
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return F.avg(F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0)))


def macro_f1(found: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 over the classes that truth or prediction has, by ``keys``; an F1 that is undefined is 0."""
    return _class_counts(found, keys, {}).groupBy(*keys).agg(_mean_f1().alias("macro_f1"))


def field_scores(found: DataFrame) -> DataFrame:
    """n, accuracy, adjacent and partial accuracy and macro F1 of each field of ``judged`` pairs, in one pass over them."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    sums = {"pairs": F.lit(1).cast("long"), "hits": yes("hit"), "adjacents": yes("adjacent"), "likeness": F.col("partial"), "likened": F.col("partial").isNotNull().cast("long")}
    share = lambda c, of: F.try_divide(F.sum(c).cast("double"), F.sum(of))
    return _class_counts(found, ("field",), sums).groupBy("field").agg(
        F.sum("pairs").alias("n"), share("hits", "pairs").alias("accuracy"), share("adjacents", "pairs").alias("adjacent_accuracy"),
        share("likeness", "likened").alias("partial_credit"), _mean_f1().alias("macro_f1"),
    )


def confusion(found: DataFrame) -> DataFrame:
    """Wrong (truth, pred) pairs of each field with their number and the first name that has them."""
    return found.where(~F.col("hit")).groupBy("field", "truth", "pred").agg(F.count("*").alias("count"), F.min("name").alias("first_name"))


def mean_field_accuracy(scores: DataFrame) -> DataFrame:
    """Mean of the fields' accuracies, each rounded to four places first."""
    return scores.where("n > 0").agg(F.avg(F.round("accuracy", 4)).alias("mean_field_accuracy"))


def name_status(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """Each name of either side: matched, unlabelled or missing from the predictions."""
    p, t = predicted.select("name").distinct().withColumn("p", F.lit(True)), labelled.select("name").distinct().withColumn("t", F.lit(True))
    both = p.join(t, "name", "full")
    return both.select("name", F.when(F.col("p") & F.col("t"), "matched").when(F.col("p"), "unlabelled").otherwise("missing_prediction").alias("status"))


def rank_order(field: str, ranks: dict[str, tuple[str, ...]] = RANKS) -> Column:
    """Sort key of an ordinal field: its rank, unknown values last."""
    order = F.array(*map(F.lit, ranks[field]))
    return F.coalesce(F.nullif(F.array_position(order, F.col(field)), F.lit(0)), F.lit(len(ranks[field]) + 1))


def with_groups(clips: DataFrame, groups: DataFrame) -> DataFrame:
    """clips(name) with ``grp`` of groups(name, grp); a clip without one is a group of its own."""
    return clips.join(groups.select("name", "grp"), "name", "left").withColumn("grp", F.coalesce(F.col("grp").cast("string"), F.col("name").cast("string")))


def overlap_rule(speech_s: Column, measured: Column) -> Column:
    """Overlap is 0 without speech, what was measured if anything was, else unknown."""
    return F.when(speech_s <= 0, 0.0).otherwise(measured)
