"""Class scores: votes by term, shares, best and top classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.vocab import class_term

# Classes considered, the least score of them, and classes kept.
CONSIDERED, LEAST_SCORE, KEPT = 25, 0.02, 8


def top_scores(scores: DataFrame, keep: int = CONSIDERED, least: float = LEAST_SCORE) -> DataFrame:
    """The ``keep`` best of scores(file_id, name, score) of each file above ``least``; ties by name."""
    best = Window.partitionBy("file_id").orderBy(F.col("score").desc(), "name")
    return scores.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= keep) & (F.col("score") > least))


def class_votes(scores: DataFrame) -> DataFrame:
    """Summed scores of the terms that scores(file_id, name, score) stand for.

    Names are turned into terms once each, not once a row; ignored and unknown ones go.
    """
    names = scores.select("name").distinct().withColumn("term", class_term(F.col("name"))).where(F.col("term").isNotNull())
    return scores.join(names, "name").groupBy("file_id", "term").agg(F.sum("score").alias("score"))


def shares(votes: DataFrame) -> DataFrame:
    """Votes as shares of their file's sum, where that is positive."""
    total = F.sum("score").over(Window.partitionBy("file_id"))
    return votes.withColumn("total", total).withColumn("share", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.col("score"))).drop("total")


def ranked(votes: DataFrame, by: str, keep: int) -> DataFrame:
    best = Window.partitionBy("file_id").orderBy(F.col(by).desc(), "term")
    return votes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def as_map(votes: DataFrame, by: str = "share") -> DataFrame:
    """One map of term to share for each file."""
    return votes.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", by)))).alias("noise_class_dist"))


def add_signature(votes: DataFrame, signature: DataFrame, weight: float = 0.5) -> DataFrame:
    """Votes with those of a spectral signature added at ``weight``; a file without votes takes it whole."""
    voted = votes.select("file_id").distinct().withColumn("voted", F.lit(True))
    weighed = signature.join(voted, "file_id", "left").select("file_id", "term", (F.col("score") * F.when(F.col("voted"), weight).otherwise(1.0)).alias("score"))
    return votes.select("file_id", "term", "score").union(weighed).groupBy("file_id", "term").agg(F.sum("score").alias("score"))


def spectral_signature(shape: DataFrame) -> DataFrame:
    """Terms that the shape of a noise spectrum suggests: shape(file_id, flatness, low_share, high_share, hum_share)."""
    flat, low, high, hum = (F.col(c) for c in ("flatness", "low_share", "high_share", "hum_share"))
    strength = lambda x, edge, scale: 0.4 + 0.4 * F.least(F.lit(1.0), (x - edge) / scale)
    found = F.array_compact(
        F.array(
            F.when((flat > 0.65) & (high > 0.35), F.struct(F.lit("static").alias("term"), strength(flat, 0.65, 0.3).alias("score"))),
            F.when(hum > 0.30, F.struct(F.lit("hum").alias("term"), strength(hum, 0.30, 0.4).alias("score"))),
            F.when((low > 0.70) & (high < 0.05), F.struct(F.lit("road noise").alias("term"), strength(low, 0.70, 0.25).alias("score"))),
        )
    )
    return shape.select("file_id", F.explode(found).alias("x")).select("file_id", "x.term", "x.score")
