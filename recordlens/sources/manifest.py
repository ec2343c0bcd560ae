"""Label manifests and uploads: CSV with JSON cells, file names and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of audio files, and what archives hold besides users' files.
AUDIO = ("wav", "mp3", "ogg", "opus", "flac", "m4a", "aac", "wma", "webm", "mp4", "aiff", "au")
JUNK_FOLDERS = ("__MACOSX", ".Spotlight-V100", ".Trashes", ".fseventsd", "$RECYCLE.BIN", "System Volume Information")
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
LABEL_SCHEMA = (
    "emotional_tone string, emotional_intensity string, background_noise_present boolean, background_noise_type string, "
    "background_noise_severity string, audio_quality string, speaker_overlap_present boolean, long_silence_present boolean, confidence double"
)
SYNTHETIC_SCHEMA = "name string, speech_source string, noise_source string, snr_db double, gap_s double, degradation string"


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, truth) of a manifest with columns name and result_json.

    Blank names and cells and broken JSON are skipped; of one name the last row counts. A byte-order
    mark is no part of the first column's name.
    """
    rows = _csv(spark).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    parsed = rows.select(
        F.trim("name").alias("name"), F.trim("result_json").alias("raw"), F.monotonically_increasing_id().alias("row")
    ).where("name <> '' AND raw <> ''").withColumn("truth", F.from_json("raw", LABEL_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    whole = parsed.where(F.col("truth._corrupt").isNull())
    return whole.groupBy("name").agg(F.max_by(F.col("truth").dropFields("_corrupt"), "row").alias("truth"))


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """A synthetic manifest with the group key of its speech and noise sources."""
    return _csv(spark).schema(SYNTHETIC_SCHEMA).csv(path).withColumn("grp", F.concat_ws("|", "speech_source", "noise_source"))


def scan_audio(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all audio files below a folder, whatever their suffix's case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.where(suffix(F.col("path")).isin(*AUDIO)).select("path", "length", "content")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    return F.filter(F.split(slashed(path), "/"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def suffix(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; '' without one or before one only."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def is_junk(path: Column) -> Column:
    """Archive noise: a metadata folder on the way, a resource fork, or a metadata file."""
    name = basename(path)
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, JUNK_FOLDERS))) | name.startswith("._") | name.isin(*JUNK_NAMES)


def classify(path: Column) -> Column:
    """junk, audio, manifest or skipped."""
    return F.when(is_junk(path), "junk").when(suffix(path).isin(*AUDIO), "audio").when(suffix(path) == "csv", "manifest").otherwise("skipped")


def display_names(files: DataFrame) -> DataFrame:
    """``label`` of files(path): the base name where it is the only one, else the path without its first part.

    Of equal labels the second and later, by path, get a number before their suffix.
    """
    name, all_parts = basename(F.col("path")), parts(F.col("path"))
    rest = F.array_join(F.slice(all_parts, 2, F.greatest(F.size(all_parts) - 1, F.lit(1))), "/")
    named = files.withColumns({"_base": name, "_same": F.count("*").over(Window.partitionBy(name))})
    labelled = named.withColumn("label", F.when((F.col("_same") == 1) | (rest == ""), F.col("_base")).otherwise(rest))
    nth = labelled.withColumn("_n", F.row_number().over(Window.partitionBy("_base", "label").orderBy("path")) - 1)
    last = F.regexp_extract("label", r"([^/.])(\.[^./]*)$", 2)
    stem = F.expr("substring(_base, 1, length(_base) - length(_last))")
    numbered = F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), F.col("_last"))
    return nth.withColumn("_last", last).withColumn("label", F.when(F.col("_n") > 0, numbered).otherwise(F.col("label"))).drop("_base", "_same", "_n", "_last")


def choose_manifest(candidates: DataFrame) -> DataFrame:
    """The first of candidates(path, rows) that has rows, by depth, then path."""
    depth = F.size(parts(F.col("path")))
    return candidates.where("rows > 0").withColumn("depth", depth).orderBy("depth", "path").limit(1)


def rekey(labels: DataFrame, shown: DataFrame) -> DataFrame:
    """labels(name, row) under the names shown(name) where only the folder differs.

    A label whose name isn't shown takes the one shown name of its base name. A label that has its
    own name shown wins over those that would take it; of several that would, the last row wins.
    """
    exact = labels.join(shown, "name", "left_semi").withColumn("exact", F.lit(1))
    loose = labels.join(shown, "name", "left_anti").withColumn("_base", basename(F.col("name")))
    single = shown.groupBy(basename(F.col("name")).alias("_base")).agg(F.count("*").alias("n"), F.min("name").alias("target")).where("n = 1")
    moved = loose.join(single, "_base", "left")
    taken = moved.where("target IS NOT NULL").select(F.col("target").alias("name"), F.col("name").alias("was"), "row", F.lit(0).alias("exact"))
    kept = moved.where("target IS NULL").select("name", F.col("name").alias("was"), "row", F.lit(0).alias("exact"))
    best = Window.partitionBy("name").orderBy(F.col("exact").desc(), F.col("row").desc())
    matched = exact.select("name", F.col("name").alias("was"), "row", "exact").union(taken).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return matched.select("name", "was", "row", F.lit(True).alias("matched")).union(kept.select("name", "was", "row", F.lit(False)))
