"""Intervals over ordered rows: hysteresis, merging, gaps, runs and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Probabilities that open and close a region, seconds of padding, merging and least length.
ENTER, LEAVE = 0.50, 0.35
PAD_S, MERGE_S, LEAST_S = 0.06, 0.20, 0.12
GAP_TOLERANCE_S = 1e-6
#: Fixed value: the shortest utterance that counts, in seconds.
UTTERANCE_S = 0.60


def _by(*order: str):
    return Window.partitionBy("file_id").orderBy(*order)


def raw_regions(frames: DataFrame, hop: float, enter: float = ENTER, leave: float = LEAVE) -> DataFrame:
    """Regions of frames(file_id, i, prob): open at ``enter``, closed where prob falls below ``leave``.

    The state at a frame is that of the last frame that decided it; a region begins where the state
    rises and ends one hop after the frame that closed it, or at the end of the file.
    """
    decided = F.when(F.col("prob") >= enter, 1).when(F.col("prob") < leave, 0)
    state = F.coalesce(F.last(decided, ignorenulls=True).over(_by("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    stated = frames.withColumn("on", state)
    before = F.coalesce(F.lag("on").over(_by("i")), F.lit(0))
    turns = stated.withColumn("was", before).withColumn("frames", F.max("i").over(Window.partitionBy("file_id")) + 1)
    edges = turns.where("on <> was").select("file_id", "i", "on", "frames")
    closed = F.coalesce((F.lead("i").over(_by("i")) + 1) * hop, F.col("frames") * hop)
    return (
        edges.withColumn("end_s", closed).where("on = 1")
        .select("file_id", (F.col("i") * hop).alias("start_s"), "end_s", (F.col("frames") * hop).alias("duration_s"))
    )


def merge_regions(regions: DataFrame, pad: float = PAD_S, gap: float = MERGE_S, least: float = LEAST_S) -> DataFrame:
    """Regions padded within the file, merged where less than ``gap`` apart, those of at least ``least``."""
    padded = regions.withColumns(
        {"start_s": F.greatest(F.lit(0.0), F.col("start_s") - pad), "end_s": F.least(F.col("duration_s"), F.col("end_s") + pad)}
    )
    apart = F.coalesce(F.col("start_s") - F.lag("end_s").over(_by("start_s")) >= gap, F.lit(True))
    island = F.sum(F.col("new").cast("int")).over(_by("start_s").rowsBetween(Window.unboundedPreceding, 0))
    return (
        padded.withColumn("new", apart).withColumn("island", island)
        .groupBy("file_id", "island")
        .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("duration_s").alias("duration_s"))
        .where(F.col("end_s") - F.col("start_s") >= least).drop("island")
    )


def speech_regions(frames: DataFrame, hop: float) -> DataFrame:
    return merge_regions(raw_regions(frames, hop))


def gaps(regions: DataFrame, files: DataFrame) -> DataFrame:
    """What regions(file_id, start_s, end_s) leave of files(file_id, duration_s), head and tail included."""
    inner = regions.select("file_id", F.coalesce(F.lag("end_s").over(_by("start_s")), F.lit(0.0)).alias("start_s"), F.col("start_s").alias("end_s"))
    ends = regions.groupBy("file_id").agg(F.max("end_s").alias("last_s"))
    tail = files.join(ends, "file_id", "left").select("file_id", F.coalesce("last_s", F.lit(0.0)).alias("start_s"), F.col("duration_s").alias("end_s"))
    return inner.union(tail).where(F.col("end_s") - F.col("start_s") > GAP_TOLERANCE_S)


def speech_summary(regions: DataFrame, files: DataFrame) -> DataFrame:
    """Speech seconds, their share and the longest gap of each file; one pass over the regions."""
    before = F.coalesce(F.lag("end_s").over(_by("start_s")), F.lit(0.0))
    spoken = regions.withColumn("gap", F.col("start_s") - before).groupBy("file_id").agg(
        F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s"), F.count("*").alias("n_regions"), F.max("gap").alias("gap"), F.max("end_s").alias("last_s")
    )
    longest = F.greatest("gap", F.col("duration_s") - F.coalesce("last_s", F.lit(0.0)))
    joined = files.join(spoken, "file_id", "left").withColumn("max_silence_s", F.when(longest > GAP_TOLERANCE_S, longest))
    return joined.select(
        "file_id",
        "duration_s",
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"),
        F.coalesce("speech_s", F.lit(0.0)).alias("speech_s"),
        F.coalesce(F.try_divide("speech_s", F.nullif("duration_s", F.lit(0.0))), F.lit(0.0)).alias("speech_ratio"),
        F.coalesce("max_silence_s", F.lit(0.0)).alias("max_silence_s"),
    )


def adjacent(rows: DataFrame) -> DataFrame:
    """rows(file_id, i) with ``island``, equal for rows of a file whose ``i`` follow one another."""
    return rows.withColumn("island", F.col("i") - F.row_number().over(_by("i")))


def true_runs(rows: DataFrame, flag: Column) -> DataFrame:
    """Runs of adjacent rows(file_id, i) where ``flag`` holds: first, last and number of rows."""
    return adjacent(rows.where(flag)).groupBy("file_id", "island").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n")).drop("island")


def stab(points: DataFrame, at: str, spans: DataFrame, cell: float = 60.0) -> DataFrame:
    """The points(file_id, at, ...) that lie in any span(file_id, start_s, end_s), ends included.

    Spans are laid over cells of ``cell`` seconds, so that the join is by file and cell; a file with
    very many spans, or of great length, is spread over its cells.
    """
    index = lambda x: F.floor(F.col(x) / cell)
    whole = spans.where("end_s >= start_s")
    cells = whole.select(
        F.col("file_id").alias("_f"), F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), F.explode(F.sequence(index("start_s"), index("end_s"))).alias("_c")
    )
    placed = points.withColumn("_p", index(at))
    held = (F.col("file_id") == F.col("_f")) & (F.col("_p") == F.col("_c")) & F.col(at).between(F.col("_a"), F.col("_b"))
    return placed.join(cells, held, "left_semi").drop("_p")


def long_enough(utterances: DataFrame, least_s: float = UTTERANCE_S) -> DataFrame:
    """The utterances(start_s, end_s, ...) of ``least_s`` seconds or more; shorter ones say too little of a voice."""
    return utterances.where(F.col("end_s") - F.col("start_s") >= least_s)


def text_in_regions(utterances: DataFrame, regions: DataFrame) -> DataFrame:
    """Text of the utterances(file_id, start_s, end_s, text) whose middle lies in a region, in order.

    A file without regions keeps all of its utterances.
    """
    timed = utterances.withColumn("mid_s", (F.col("start_s") + F.col("end_s")) / 2)
    inside = stab(timed, "mid_s", regions)
    free = timed.join(regions.select("file_id").distinct(), "file_id", "left_anti")
    return joined_text(inside.unionByName(free))


def joined_text(utterances: DataFrame, *keys: str) -> DataFrame:
    """The text of each file (and further keys), by start, with single spaces between."""
    ordered = F.array_sort(F.collect_list(F.struct("start_s", "end_s", "text")))
    return utterances.groupBy("file_id", *keys).agg(F.array_join(F.transform(ordered, lambda u: u["text"]), " ").alias("text"))


def frame_range(start: Column, end: Column, rate: float | Column, frames: Column, whole_end: bool = False) -> tuple[Column, Column]:
    """First frame of an interval and the first after it: the end is rounded up, or down with ``whole_end``."""
    last = F.floor(end * rate) if whole_end else F.ceil(end * rate)
    return F.floor(start * rate).cast("long"), F.least(frames, last.cast("long"))


def overlap_ratio(spans: DataFrame) -> DataFrame:
    """Share of covered time of spans(file_id, start_s, end_s) that at least two of them cover."""
    edges = spans.where("end_s > start_s").select("file_id", F.explode(F.array(F.struct(F.col("start_s").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_s").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy("file_id", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    depth = F.sum("step").over(_by("at").rowsBetween(Window.unboundedPreceding, 0))
    spread = steps.withColumn("depth", depth).withColumn("length", F.lead("at").over(_by("at")) - F.col("at"))
    covered = lambda least: F.coalesce(F.sum(F.when(F.col("depth") >= least, F.col("length"))), F.lit(0.0))
    return spread.groupBy("file_id").agg(covered(1).alias("support_s"), covered(2).alias("overlap_s")).withColumn(
        "overlap_ratio", F.coalesce(F.try_divide("overlap_s", F.nullif("support_s", F.lit(0.0))), F.lit(0.0))
    )


def matched_spans(segments: DataFrame, utterances: DataFrame) -> DataFrame:
    """Segments joined to utterances by times rounded to milliseconds; of equal utterances the last counts."""
    key = lambda c: F.round(F.col(c) * 1000).cast("long")
    last = utterances.groupBy("file_id", key("start_s").alias("_a"), key("end_s").alias("_b")).agg(F.max_by("text", "seq").alias("text"))
    keyed = segments.withColumns({"_a": key("start_s"), "_b": key("end_s")})
    return keyed.join(last, ["file_id", "_a", "_b"]).drop("_a", "_b")
