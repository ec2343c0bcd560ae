"""Command line: analyse a folder of recordings, write the results, score them against labels."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from functools import cached_property
from time import perf_counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordlens import sinks
from recordlens.config import TUNED, read_thresholds
from recordlens.operators import samples, score
from recordlens.operators.intervals import speech_summary
from recordlens.operators.jobs import stage_totals
from recordlens.plans.impairment import impairments
from recordlens.plans.noise import noise
from recordlens.plans.pipeline import Estimates, Stage, Stub, analyse, build
from recordlens.plans.prosody import RATE, prosody
from recordlens.plans.roles import customer
from recordlens.plans.tone import customer_tone
from recordlens.schema import FIELDS
from recordlens.sources import audio, manifest, pcm

#: What models outside may give, by the columns of each table beside ``name``.
OUTSIDE = {
    "estimates": "any estimates", "regions": "start_s, end_s of speech", "windows": "start_s, end_s, embedding of speakers",
    "utterances": "start_s, end_s, text, embedding", "classes": "label, p of emotions", "words": "lexical, the valence of a transcript",
    "noise_votes": "term, score",
}


def _arguments(arguments: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--labels", help="CSV with name and result_json")
    parser.add_argument("--out", default="results")
    parser.add_argument("--stack", default="all", help="stages: all, none, or a list")
    for what, columns in OUTSIDE.items():
        parser.add_argument(f"--{what.replace('_', '-')}", help=f"Parquet of a model outside: name, {columns}")
    parser.add_argument("--thresholds", help="YAML of thresholds")
    return parser.parse_args(arguments)


class Recordings:
    """The files below a folder: headers and decoded rows, by seeking where Python reaches the store, else as whole cells."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.suffixes = ",".join(manifest.AUDIO)
        self.files = manifest.scan_audio(spark, folder)
        self.seekable = pcm.reachable(folder)

    def _named(self, df: DataFrame) -> DataFrame:
        """A recording is known by its path below the folder; names that are shown come from that at the end."""
        root = self.folder.rstrip("/").partition("://")[2] or self.folder.rstrip("/").removeprefix("file:")
        below = F.when(F.instr("path", root) > 0, F.substring_index(F.col("path"), f"{root}/", -1)).otherwise(F.col("path"))
        return df.withColumn("path", F.concat(F.lit("./"), below))

    def heads(self) -> DataFrame:
        """(path, rate, channels, frames, duration_s, error)."""
        if self.seekable:
            return self._named(pcm.read_pcm(self.spark, self.folder, only="headers", suffixes=self.suffixes))
        return self._named(audio.probe(self.files))

    def rows(self, rate: int | None = None, tail_s: float = 0.0, row_samples: int = pcm.ROW_SAMPLES) -> DataFrame:
        if self.seekable:
            return self._named(pcm.read_pcm(self.spark, self.folder, rate=rate, tail_s=tail_s, row_samples=row_samples, suffixes=self.suffixes))
        return self._named(audio.decode(self.files, rate, tail_s, row_samples))


class Given:
    """Tables of models outside, by the names that are shown; each may be absent."""

    def __init__(self, spark: SparkSession, shown: DataFrame, places: dict[str, str | None]) -> None:
        self.spark, self.shown, self.places = spark, shown.select(F.col("path").alias("file_id"), F.col("label").alias("_shown")), places

    def __call__(self, what: str) -> DataFrame | None:
        """The table with ``file_id`` in place of ``name``."""
        if not self.places.get(what):
            return None
        known = self.spark.read.parquet(self.places[what])
        return known.join(self.shown, F.col("name") == F.col("_shown")).select("file_id", *[c for c in known.columns if c not in ("name", "file_id")])


class Analysis:
    """The stages that measure: each makes a table of estimates by name when it is asked for."""

    def __init__(self, recordings: Recordings, heads: DataFrame, given: Given, work: str) -> None:
        self.recordings, self.given, self.work = recordings, given, work
        self.seconds: dict[str, float] = {}
        self.heads = heads.where("error IS NULL").select(F.col("path").alias("file_id"), "rate", F.col("frames").alias("length"), "duration_s")
        self.regions = given("regions")
        self.voiced = bool(given.places.get("windows") and given.places.get("utterances"))

    def _kept(self, df: DataFrame, what: str) -> DataFrame:
        """Written beside the results, so that stages share it."""
        df.write.mode("overwrite").parquet(f"{self.work}/{what}")
        return df.sparkSession.read.parquet(f"{self.work}/{what}")

    @cached_property
    def native(self) -> DataFrame:
        return self.recordings.rows(None, samples.TAIL_S, samples.ROW_SAMPLES)

    @cached_property
    def measured(self) -> DataFrame:
        spans = None if self.regions is None else samples.masks(self.regions, self.heads)
        return self._kept(samples.measured_rows(self.native, spans), "measured")

    @cached_property
    def speech(self) -> DataFrame:
        return self._kept(speech_summary(self.regions, self.heads.select("file_id", "duration_s")), "speech")

    @cached_property
    def customer(self) -> tuple[DataFrame, DataFrame]:
        found, spans = customer(self.recordings.rows(RATE), self.speech, self.regions, self.given("windows"), self.given("utterances"))
        return self._kept(found, "roles"), self._kept(spans, "customer")

    def _timed(self, name: str, make: Callable[[], DataFrame], *columns: str) -> Estimates:
        """The stage's table, written beside the results, and the seconds that this took."""
        began = perf_counter()
        table = self._kept(make().withColumnRenamed("file_id", "name").select("name", *columns), f"stage-{name}")
        self.seconds[name] = perf_counter() - began
        return Estimates(name, table, *columns)

    def vad(self) -> Estimates:
        return self._timed("vad", lambda: self.speech, "speech_ratio", "max_silence_s")

    def quality(self) -> Estimates:
        return self._timed("quality", lambda: impairments(self.measured, self.native, self.regions), "degradation_score")

    def noise(self) -> Estimates:
        return self._timed("noise", lambda: noise(self.measured, self.given("noise_votes")), "noise_level_db", "noise_class_dist")

    def roles(self) -> Estimates:
        return self._timed("roles", lambda: self.customer[0], "n_speakers", "role_confidence", "customer_speech_s")

    def emotion(self) -> Estimates:
        """Arousal and valence of the customer, or, without regions of speech, arousal of the whole recording from prosody."""
        rows = self.recordings.rows(RATE)
        if self.regions is None:
            return self._timed("emotion", lambda: prosody(rows).select("file_id", "arousal"), "arousal")
        roles, spans = self.customer if self.voiced else (None, None)
        return self._timed("emotion", lambda: customer_tone(rows, self.speech, spans, self.given("classes"), self.given("words"), roles), "arousal", "valence", "valence_source")

    def times(self, audio_s: Column, total_s: float) -> Column:
        """Each stage's seconds as a map, shared out over the recordings by their length."""
        share = F.try_divide(audio_s, F.lit(total_s))
        return F.map_from_arrays(F.array(*map(F.lit, self.seconds)), F.array(*[F.lit(s) * share for s in self.seconds.values()])) if self.seconds else F.create_map().cast("map<string,double>")

    def makers(self) -> dict[str, Callable[[], Stage]]:
        """What can be measured from what is given: roles need regions, windows and utterances."""
        made: dict[str, Callable[[], Stage]] = {"quality": self.quality, "noise": self.noise, "emotion": self.emotion, "stub": Stub}
        if self.regions is not None:
            made |= {"vad": self.vad} | ({"roles": self.roles} if self.voiced else {})
        return made


def judged_results(results: DataFrame, labels: DataFrame) -> DataFrame:
    """The fields of ok results beside labels(name, truth), and whether they agree."""
    fields = [f for f in FIELDS if f != "confidence"]
    predicted = score.unpivot(results.where("status = 'ok'"), "name", {f: F.col(f) for f in fields})
    truth = score.unpivot(labels, "name", {f: F.col(f"truth.{f}") for f in fields})
    return score.judged(score.pairs(predicted, truth))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if there was anything to analyse, else 1."""
    given = _arguments(arguments)
    spark = spark or SparkSession.builder.appName("recordlens").getOrCreate()
    try:
        recordings = Recordings(spark, given.folder)
        empty = recordings.files.select("path").isEmpty()
    except AnalysisException as problem:
        print(f"{given.folder}: {problem.getCondition()}", file=sys.stderr)
        return 1
    if empty:
        print(f"{given.folder}: no audio", file=sys.stderr)
        return 1
    work = f"{given.out}/work"
    recordings.heads().write.mode("overwrite").parquet(f"{work}/heads")
    probed = spark.read.parquet(f"{work}/heads")
    heads = probed.select(F.col("path").alias("name"), F.coalesce("duration_s", F.lit(0.0)).alias("audio_s"), "error")
    outside = Given(spark, manifest.display_names(probed.select("path")), {what: getattr(given, what) for what in OUTSIDE})
    analysis = Analysis(recordings, probed, outside, work)
    stages = build(given.stack, analysis.makers())
    if (known := outside("estimates")) is not None:
        table = known.withColumnRenamed("file_id", "name")
        stages.insert(max(0, len(stages) - 1), Estimates("estimates", table, *[c for c in table.columns if c != "name"]))
    thresholds = read_thresholds(given.thresholds) if given.thresholds else TUNED
    observed: dict[str, Observation] = {}
    total_s = heads.agg(F.sum("audio_s")).first()[0] or 0.0
    timed = heads.withColumn("stage_times", F.when(F.col("error").isNull(), analysis.times(F.col("audio_s"), total_s)))
    results = analyse(timed.withColumn("elapsed_s", F.aggregate(F.map_values("stage_times"), F.lit(0.0), lambda a, x: a + x)), stages, thresholds, observed=observed)
    results = manifest.display_names(results.withColumnRenamed("name", "path")).withColumn("name", F.col("label")).select(*results.columns)
    results.write.mode("overwrite").parquet(f"{given.out}/results.parquet")
    done = spark.read.parquet(f"{given.out}/results.parquet")
    for name, seen in observed.items():  # filled while the results were written
        found = seen.get
        print(f"{name}: " + ", ".join(f"{c} of {found['recordings']} {what}" for what, c in found.items() if what != "recordings"))
    for row in sinks.stage_lines(stage_totals(done)).orderBy(F.col("total_s").desc()).collect():  # a row a stage
        print(row["line"])
    sinks.write_csv(done, f"{given.out}/results.csv")
    report = None
    if given.labels:
        labels = manifest.read_labels(spark, given.labels)
        judged_results(done, labels).write.mode("overwrite").parquet(f"{work}/judged")
        judged = spark.read.parquet(f"{work}/judged")
        score.field_scores(judged).write.mode("overwrite").parquet(f"{given.out}/scores.parquet")
        report = sinks.score_report(judged)
        for row in sinks.report_lines(spark.read.parquet(f"{given.out}/scores.parquet")).orderBy("field").collect():  # nine fields
            print(row["line"])
        for row in score.name_status(done.where("status = 'ok'"), labels).where("status <> 'matched'").groupBy("status").count().orderBy("status").collect():
            print(f"{row['status'].replace('_', ' ')}: {row['count']}")
    if report is None:
        sinks.write_json(done, f"{given.out}/results.json")
    else:
        sinks.write_json(done, f"{given.out}/results.json", given.folder, report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
