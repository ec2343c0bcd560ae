"""Who is the customer, as a cascade: words where they decide, else the sound of the voices, else all of the speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.scalars import rounded
from recordlens.operators import clusters, roles, samples
from recordlens.operators.intervals import joined_text, long_enough, matched_spans, stab
from recordlens.shared import cut
from recordlens.sources.pcm import ROW_SAMPLES

RATE = 16_000
LEXICAL, ACOUSTIC, ONE_VOICE, SILENT = "lexical", "acoustic", "one voice", "silent"


def assigned(speech: DataFrame, lexical: DataFrame, acoustic: DataFrame) -> DataFrame:
    """``(file_id, n_speakers, customer, role_confidence, how)`` of speech(file_id, speech_s).

    ``lexical`` are clusters(file_id, cluster, votes, floor_db) of utterances, ``acoustic`` clusters(file_id, cluster,
    floor_db, level_sd, first_start_s, votes) of windows. Only what words don't decide goes on to the sound; a
    file whose voices don't separate is all customer with little confidence; one without speech has no speaker.
    """
    speaking = speech.where(F.coalesce("speech_s", F.lit(0.0)) > 0).select("file_id")
    words = roles.lexical_roles(lexical.join(speaking, "file_id", "left_semi"))
    counts = lexical.groupBy("file_id").agg(F.count("*").cast("int").alias("n_speakers"))
    decided = words.join(counts, "file_id").select("file_id", "n_speakers", "customer", "role_confidence", F.lit(LEXICAL).alias("how"))
    open_ = speaking.join(decided, "file_id", "left_anti")
    rest = acoustic.join(open_, "file_id", "left_semi")
    many = rest.groupBy("file_id").agg(F.count("*").cast("int").alias("n_speakers"))
    heard = roles.acoustic_roles(rest.join(many.where("n_speakers >= 2"), "file_id", "left_semi")).where("rank = 1")
    by_sound = heard.join(many, "file_id").select("file_id", "n_speakers", F.col("cluster").alias("customer"), "role_confidence", F.lit(ACOUSTIC).alias("how"))
    none = F.lit(None).cast("int").alias("customer")
    alone = open_.join(many, "file_id", "left").where(F.coalesce("n_speakers", F.lit(1)) < 2).select(
        "file_id", F.lit(1).alias("n_speakers"), none, F.lit(roles.ONE_SPEAKER).alias("role_confidence"), F.lit(ONE_VOICE).alias("how")
    )
    silent = speech.join(speaking, "file_id", "left_anti").select("file_id", F.lit(0).alias("n_speakers"), none, F.lit(0.0).alias("role_confidence"), F.lit(SILENT).alias("how"))
    return decided.unionByName(by_sound).unionByName(alone).unionByName(silent).withColumn("role_confidence", rounded(rounded(F.col("role_confidence"), 6), 4))  # the last bits don't decide


def customer_spans(found: DataFrame, lexical_spans: DataFrame, acoustic_spans: DataFrame, regions: DataFrame) -> DataFrame:
    """``(file_id, start_s, end_s)``: the customer's segments, windows or, of one voice, all regions of speech."""
    of = lambda how, spans: spans.join(found.where(F.col("how") == how).select("file_id", F.col("customer").alias("cluster")), ["file_id", "cluster"], "left_semi")
    all_ = regions.join(found.where(F.col("how") == ONE_VOICE).select("file_id"), "file_id", "left_semi")
    kept = [part.select("file_id", "start_s", "end_s") for part in (of(LEXICAL, lexical_spans), of(ACOUSTIC, acoustic_spans), all_)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def with_customer_speech(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``found`` with ``customer_speech_s``, the seconds of ``customer_spans``."""
    seconds = spans.groupBy("file_id").agg(F.round(F.sum(F.col("end_s") - F.col("start_s")), 2).alias("customer_speech_s"))
    return found.join(seconds, "file_id", "left").withColumn("customer_speech_s", F.coalesce("customer_speech_s", F.lit(0.0)))


def _levels(rows: DataFrame, spans: DataFrame, row_samples: int) -> DataFrame:
    return samples.cluster_levels(cut(samples.window_levels(rows, spans, RATE, row_samples)))


def lexical_clusters(rows: DataFrame, utterances: DataFrame, row_samples: int = ROW_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Clusters of utterances(file_id, start_s, end_s, text, embedding) with their votes and floors, and the segments in them.

    Utterances that are long enough are clustered by voice, however close the voices lie. A segment's text is
    that of the utterance with its times; of equal ones the last counts.
    """
    own = long_enough(utterances).withColumn("id", F.struct("start_s", "end_s", "text"))
    found = cut(clusters.speakers(own, separate=False).drop("separation"))
    spans = found.select("file_id", "cluster", F.col("id.start_s").alias("start_s"), F.col("id.end_s").alias("end_s"), F.xxhash64("id").alias("win"))
    told = matched_spans(spans, utterances.withColumn("seq", F.struct("start_s", "end_s", "text")))
    votes = joined_text(told, "cluster").select("file_id", "cluster", roles.agent_votes(F.col("text")).alias("votes"))
    levels = _levels(rows, spans, row_samples)
    all_ = spans.select("file_id", "cluster").distinct().join(votes, ["file_id", "cluster"], "left").join(levels, ["file_id", "cluster"], "left")
    return all_.select("file_id", "cluster", F.coalesce("votes", F.lit(0.0)).alias("votes"), F.coalesce("floor_db", F.lit(0.0)).alias("floor_db")), spans


def acoustic_clusters(rows: DataFrame, windows: DataFrame, utterances: DataFrame | None, row_samples: int = ROW_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """Clusters of windows(file_id, start_s, end_s, embedding) with what speaks for the customer, and the windows in them."""
    found = cut(clusters.speakers(windows.withColumn("id", F.struct("start_s", "end_s"))).drop("separation"))
    spans = found.select("file_id", "cluster", F.col("id.start_s").alias("start_s"), F.col("id.end_s").alias("end_s"), F.xxhash64("id").alias("win"))
    each = spans.groupBy("file_id", "cluster").agg(F.min("start_s").alias("first_start_s"))
    joined = each.join(_levels(rows, spans, row_samples), ["file_id", "cluster"], "left")
    if utterances is None:
        votes = each.select("file_id", "cluster", F.lit(0.0).alias("votes"))
    else:
        of_cluster = lambda df: df.withColumn("file_id", F.struct("file_id", "cluster"))
        timed = of_cluster(utterances.join(each.select("file_id", "cluster"), "file_id")).withColumn("mid_s", (F.col("start_s") + F.col("end_s")) / 2)
        text = joined_text(stab(timed, "mid_s", of_cluster(spans)))
        votes = text.select("file_id.file_id", "file_id.cluster", roles.agent_votes(F.col("text")).alias("votes"))
    known = joined.join(votes, ["file_id", "cluster"], "left")
    return known.select("file_id", "cluster", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("floor_db", "level_sd")], "first_start_s", F.coalesce("votes", F.lit(0.0)).alias("votes")), spans


def customer(rows: DataFrame, speech: DataFrame, regions: DataFrame, windows: DataFrame, utterances: DataFrame, row_samples: int = ROW_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """``(file_id, n_speakers, role_confidence, customer_speech_s, how)`` of recordings decoded at RATE, and the customer's spans.

    ``speech`` is (file_id, speech_s), ``regions`` those of speech; ``windows`` and ``utterances`` carry the embeddings of a speaker model.
    """
    lexical, segments = lexical_clusters(rows, utterances, row_samples)
    acoustic, own = acoustic_clusters(rows, windows, utterances, row_samples)
    found = cut(assigned(speech, cut(lexical), cut(acoustic)))
    spans = customer_spans(found, segments, own, regions)
    return with_customer_speech(found, spans).drop("customer"), spans
