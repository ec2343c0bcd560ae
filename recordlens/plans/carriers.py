"""Relations of the analysis, carried by the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOP = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LATENTS_SQL = """
  SELECT l_orderkey AS k, l_linenumber AS ln,
    CASE WHEN l_orderkey%7=1 THEN NULL ELSE -90.0e0+1.8e0*l_quantity END AS noise_level_db,
    CASE WHEN l_orderkey%7=2 THEN NULL ELSE l_discount*10.0e0 END AS degradation_score,
    CASE WHEN l_orderkey%7=3 THEN NULL ELSE l_linenumber*3.0e0 END AS max_silence_s,
    CASE WHEN l_orderkey%7=4 THEN NULL ELSE l_tax/2.0e0 END AS overlap_ratio,
    CASE WHEN l_orderkey%7=5 THEN NULL ELSE (l_partkey%41)/20.0e0-1.0e0 END AS arousal,
    CASE WHEN l_orderkey%7=6 THEN NULL ELSE ((l_partkey*13+l_linenumber*7)%41)/20.0e0-1.0e0 END AS valence,
    CASE WHEN l_orderkey%5=0 THEN NULL ELSE (l_orderkey%11)/10.0e0 END AS role_confidence,
    (l_partkey%10)/10.0e0 AS music, (l_suppkey%10)/10.0e0 AS alarm, l_orderkey%3=0 AS untagged
  FROM lineitem"""


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from lineitem; a third of the rows have no class scores, the others two."""
    absent = lambda r, x: F.when(F.col("l_orderkey") % 7 != r, x)
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    scores = F.create_map(F.lit("music"), (part % 10) / 10.0, F.lit("alarm"), (F.col("l_suppkey") % 10) / 10.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), line.alias("ln"),
        absent(1, -90.0 + 1.8 * F.col("l_quantity")).alias("noise_level_db"),
        absent(2, F.col("l_discount") * 10.0).alias("degradation_score"),
        absent(3, line * 3.0).alias("max_silence_s"),
        absent(4, F.col("l_tax") / 2.0).alias("overlap_ratio"),
        absent(5, (part % 41) / 20.0 - 1.0).alias("arousal"),
        absent(6, ((part * 13 + line * 7) % 41) / 20.0 - 1.0).alias("valence"),
        F.when(F.col("l_orderkey") % 5 != 0, (F.col("l_orderkey") % 11) / 10.0).alias("role_confidence"),
        F.when(F.col("l_orderkey") % 3 != 0, scores).alias("noise_class_dist"),
    )


FRAMES_SQL = """
  SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i,
    least(value/100.0e0, 1.0e0) AS prob, value
  FROM events"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (F.row_number().over(order) - 1).cast("long").alias("i"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"), "value",
    )


def packed(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """The frames' values as rows of arrays, each with the next row's beside its own: (path, first, samples, tail)."""
    placed = frames(spark, sf_dir).groupBy(F.col("file_id").cast("string").alias("path"), (F.floor(F.col("i") / size) * size).alias("first"))
    arrays = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("samples"))
    after = F.lead("samples").over(Window.partitionBy("path").orderBy("first"))
    return arrays.withColumn("tail", F.coalesce(after, F.array().cast("array<double>")))


def files(frames: DataFrame, hop: float = HOP) -> DataFrame:
    return frames.groupBy("file_id").agg(((F.max("i") + 1) * hop).alias("duration_s"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as utterances of one second each."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("file_id"), F.col("turn").cast("double").alias("start_s"), (F.col("turn") + 1.0).alias("end_s"), "role", "text", F.col("turn").alias("seq")
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tagger classes, scored by their share of 10,000 units of value."""
    named = F.create_map(*[F.lit(x) for pair in EVENT_CLASSES.items() for x in pair])
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id"), F.coalesce(F.try_element_at(named, F.col("event_type")), F.lit("Whoosh")).alias("name"))
        .agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 1e6).alias("score"))
    )


#: Classes that event types stand for, in turn; others are a class that names no term.
EVENT_CLASSES: dict[str, str] = {"click": "Car", "view": "Engine", "purchase": "Music", "signup": "Speech", "error": "Computer keyboard"}
CLASS_SCORES_SQL = """
  SELECT user_id AS file_id, CASE event_type {cases} ELSE 'Whoosh' END AS name,
    CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT)/1e6 AS score
  FROM events GROUP BY 1, 2""".format(cases=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CLASSES.items()))
