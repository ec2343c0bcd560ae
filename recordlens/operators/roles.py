"""Who is the customer: scripted language, the room behind a voice, and who speaks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.scalars import clamp

# Phrases of a scripted agent, and of a customer.
AGENT_PATTERNS = (
    r"\bi'?m calling (from|about|on behalf)", r"\bthank you for calling\b", r"\bhow (can|may) i help\b",
    r"\bi can help (you )?with (that|this)\b", r"\bis (now|this) a good time\b", r"\blet me transfer\b",
    r"\bplease hold\b", r"\bone moment\b", r"\bbear with me\b",
    r"\bi'?m (an? )?(virtual |ai |automated )?(assistant|agent)\b", r"\bthis call (may|is) be(ing)? recorded\b",
    r"\bwhat (type|kind) of (service|appointment|issue)\b", r"\bis there anything else\b",
    r"\bhave a (great|good|nice) day\b", r"\bi'?m (sorry|so sorry) to hear\b", r"\bi understand your frustration\b",
    r"\bcan i (get|have) your (name|number|account)\b", r"\bi'?m \w+ from\b", r"\bspeaking with\b",
    r"\bhow can i assist\b", r"\byou'?re (very )?welcome\b", r"\bmay i ask\b",
)
CUSTOMER_PATTERNS = (
    r"\bi (want|need|would like)\b", r"\bmy (car|vehicle|account|phone|order)\b", r"\bcan you\b",
    r"\bare you a (real )?person\b", r"\bi'?ve been waiting\b", r"\bthis is ridiculous\b",
    r"\bi'?m (not )?happy\b", r"\bwhy (is|are|do|did)\b", r"\bi (called|phoned) (about|because)\b",
)
# Weights of the signs, the differences at which they count in full, and when words settle it.
FLOOR, LEVEL_VAR, FIRST, WORDS = 1.00, 0.45, 0.30, 1.20
FLOOR_DB, LEVEL_VAR_DB, UNSURE_BELOW = 12.0, 6.0, 0.55
ONE_SPEAKER = 0.35


def pattern_hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur, whatever the case."""
    hits = F.lit(0)
    for pattern in patterns:
        hits = hits + F.coalesce(text.rlike("(?i)" + pattern), F.lit(False)).cast("int")
    return hits


def agent_votes(text: Column, agent: tuple[str, ...] = AGENT_PATTERNS, customer: tuple[str, ...] = CUSTOMER_PATTERNS) -> Column:
    return (pattern_hits(text, agent) - pattern_hits(text, customer)).cast("double")


def others_mean(value: str) -> Column:
    """Mean over the other rows of a file, without a self-join; null for the only one. Sums go in the order of first speech, the same in each run."""
    whole = Window.partitionBy("file_id").orderBy("first_start_s", "cluster").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, total = F.count(value).over(whole), F.sum(value).over(whole)
    return F.try_divide(total - F.col(value), F.nullif(n - 1, F.lit(0)))


def acoustic_roles(clusters: DataFrame) -> DataFrame:
    """Scores of clusters(file_id, cluster, floor_db, level_sd, first_start_s, votes) as the customer.

    A higher floor than the others' and more variation speak for the customer, speaking first
    against. Where the two best lie close, scripted language counts too. Adds rank and confidence.
    """
    whole = Window.partitionBy("file_id")
    scored = clusters.withColumns(
        {
            "_floor": clamp((F.col("floor_db") - others_mean("floor_db")) / FLOOR_DB, -1.0, 1.0),
            "_level": clamp((F.col("level_sd") - others_mean("level_sd")) / LEVEL_VAR_DB, -1.0, 1.0),
            "_first": F.row_number().over(whole.orderBy("first_start_s", "cluster")) == 1,
            "_spread": F.max("votes").over(whole) - F.min("votes").over(whole),
        }
    ).withColumn("score", FLOOR * F.coalesce("_floor", F.lit(0.0)) + LEVEL_VAR * F.coalesce("_level", F.lit(0.0)) - F.when(F.col("_first"), FIRST).otherwise(0.0))
    best = whole.orderBy(F.col("score").desc(), "cluster")
    lead = lambda df: df.withColumn("rank", F.row_number().over(best)).withColumn(
        "margin", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(whole) - F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole)
    )
    total = FLOOR + LEVEL_VAR + FIRST
    first = lead(scored).withColumn("_words", F.coalesce((F.col("margin") / total < UNSURE_BELOW) & (F.col("_spread") > 0), F.lit(False)))
    settled = first.withColumn("score", F.col("score") - F.when(F.col("_words"), WORDS * F.col("votes") / F.col("_spread")).otherwise(0.0))
    weight = F.when(F.col("_words"), F.lit(total + WORDS)).otherwise(total)
    return lead(settled).select(
        "file_id", "cluster", "score", "rank", F.coalesce(clamp(F.col("margin") / weight, 0.0, 1.0), F.lit(ONE_SPEAKER)).alias("role_confidence")
    )


def lexical_roles(clusters: DataFrame) -> DataFrame:
    """The customer of clusters(file_id, cluster, votes, floor_db): fewest votes, ties by cluster.

    Files of one cluster or with equal votes give no row. Confidence grows with the spread of
    votes, and where the customer's floor is above every other's.
    """
    whole = Window.partitionBy("file_id")
    marked = clusters.withColumns(
        {
            "_n": F.count("*").over(whole),
            "_spread": F.max("votes").over(whole) - F.min("votes").over(whole),
            "_rank": F.row_number().over(whole.orderBy("votes", "cluster")),
        }
    ).where((F.col("_n") >= 2) & (F.col("_spread") > 0))
    found = marked.groupBy("file_id").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("cluster"))).alias("customer"),
        F.max("_spread").alias("spread"),
        F.max(F.when(F.col("_rank") == 1, F.col("floor_db"))).alias("own"),
        F.max(F.when(F.col("_rank") > 1, F.col("floor_db"))).alias("other"),
    )
    base = clamp(F.col("spread") / 4.0, 0.15, 0.9)
    return found.select("file_id", "customer", F.when(F.col("own") > F.col("other"), F.least(F.lit(0.95), base + 0.15)).otherwise(base).alias("role_confidence"))
