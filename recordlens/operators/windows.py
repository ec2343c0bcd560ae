"""Windows over ordered rows: sliding minima, fixed windows, even samples and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of an embedding window and its step.
WINDOW_S, STEP_S = 1.25, 0.60


def sliding_minimum(rows: DataFrame, value: str, width: int) -> DataFrame:
    """Minimum of ``value`` over each full window of ``width`` rows of a file, at its first row."""
    ahead = Window.partitionBy("file_id").orderBy("i").rowsBetween(0, width - 1)
    return rows.withColumns({"low": F.min(value).over(ahead), "_n": F.count("*").over(ahead)}).where(F.col("_n") == width).select("file_id", "i", "low")


def fixed_windows(regions: DataFrame, width: float = WINDOW_S, step: float = STEP_S) -> DataFrame:
    """Windows of ``width`` every ``step`` seconds of each region, while a step is left of it."""
    n = F.floor((F.col("end_s") - F.col("start_s")) / step + 1e-9).cast("int")
    placed = regions.where(n >= 1).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    start = F.col("start_s") + F.col("k") * step
    return placed.select("file_id", "k", start.alias("win_start_s"), F.least(start + width, F.col("end_s")).alias("win_end_s"))


def even_sample(rows: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows of each file, evenly spaced from the first to the last."""
    whole = Window.partitionBy("file_id")
    counted = rows.withColumns({"_n": F.count("*").over(whole), "_r": F.row_number().over(whole.orderBy("i")) - 1})
    # row r is chosen if some k has floor(k * (n - 1) / (cap - 1)) = r
    k = F.ceil(F.col("_r") * (cap - 1) / (F.col("_n") - 1).cast("double"))
    chosen = F.when(F.col("_n") <= cap, True).otherwise(F.floor(k * (F.col("_n") - 1) / float(cap - 1)) == F.col("_r"))
    return counted.where(chosen).drop("_n", "_r")


def percentiles(rows: DataFrame, value: str, **shares: float) -> DataFrame:
    """Exact percentiles of each file, with linear interpolation."""
    return rows.groupBy("file_id").agg(*[F.percentile(value, share).alias(name) for name, share in shares.items()])


def root_mean_square(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def semitone_spread(pitches: DataFrame, least: int = 4) -> DataFrame:
    """Population deviation of pitch in semitones about each file's median; null below ``least`` values."""
    middle = pitches.groupBy("file_id").agg(F.median("f0").alias("mid"), F.count("*").alias("n"))
    tones = pitches.join(middle, "file_id").withColumn("tone", 12.0 * F.log2(F.col("f0") / F.col("mid")))
    return tones.groupBy("file_id").agg(F.max("n").alias("n"), F.stddev_pop("tone").alias("sd")).select("file_id", "n", F.when(F.col("n") >= least, F.col("sd")).alias("semitone_sd"))


def spectral_shape(bins: DataFrame, low: float, high: float) -> DataFrame:
    """Flatness and the shares of power below ``low`` and above ``high`` of bins(file_id, hz, power)."""
    floor, total = F.col("power") + 1e-14, F.sum("power")
    share = lambda where: F.coalesce(F.try_divide(F.sum(F.when(where, F.col("power")).otherwise(0.0)), F.nullif(total, F.lit(0.0))), F.lit(0.0))
    return bins.groupBy("file_id").agg(
        (F.exp(F.avg(F.log(floor))) / F.avg(floor)).alias("flatness"),
        share(F.col("hz") < low).alias("low_share"),
        share(F.col("hz") >= high).alias("high_share"),
    )


def channel_correlation(samples: DataFrame, least_deviation: float = 1e-9, stereo_below: float = 0.98) -> DataFrame:
    """Correlation of samples(file_id, left, right); channels that don't vary count as equal."""
    sums = samples.groupBy("file_id").agg(
        F.stddev_pop("left").alias("sl"), F.stddev_pop("right").alias("sr"), F.covar_pop("left", "right").alias("cov")
    )
    varies = (F.col("sl") > least_deviation) & (F.col("sr") > least_deviation)
    corr = F.when(varies, F.try_divide("cov", F.col("sl") * F.col("sr"))).otherwise(1.0)
    return sums.select("file_id", F.coalesce(corr, F.lit(1.0)).alias("channel_corr")).withColumn("true_stereo", F.col("channel_corr") < stereo_below)


def masked_frames(frames: DataFrame, spans: DataFrame, first: Column, after: Column) -> DataFrame:
    """The frames(file_id, i) that spans cover: span columns give the first frame and the first after it.

    The three conventions of a mask differ in these two expressions only; a file without spans
    keeps all of its frames.
    """
    ranges = spans.select("file_id", first.alias("_a"), after.alias("_b")).where("_b > _a")
    covered = ranges.select("file_id", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("i")).distinct()
    inside = frames.join(covered, ["file_id", "i"], "left_semi")
    return inside.unionByName(frames.join(spans.select("file_id").distinct(), "file_id", "left_anti"))


def voiced(frames: DataFrame, db: str, below: float = 25.0) -> DataFrame:
    """The frames whose level lies at most ``below`` under their file's 90th percentile."""
    high = frames.groupBy("file_id").agg(F.percentile(db, 0.9).alias("_high"))
    return frames.join(high, "file_id").where(F.col(db) > F.col("_high") - below).drop("_high")


def _short_minimum(power: DataFrame, width: int, least: int = 3) -> DataFrame:
    """Minima of files of at most ``width`` frames, over half of these, or ``least``; a band of such a file fits in a row."""
    track = power.groupBy("file_id", "band").agg(F.array_sort(F.collect_list(F.struct("i", "power"))).alias("x"))
    size = F.greatest(F.lit(least), F.floor(F.size("x") / 2).cast("int"))
    spans = F.when(F.size("x") >= size, F.sequence(F.lit(1), F.size("x") - size + 1))
    lows = F.transform(spans, lambda k: F.struct(F.element_at("x", k)["i"].alias("i"), F.array_min(F.slice(F.col("x")["power"], k, size)).alias("low")))
    return track.select("file_id", "band", F.explode(lows).alias("y")).select("file_id", "y.i", "band", "y.low")


def noise_level(power: DataFrame, speech: DataFrame, width: int, bias: float = 1.5, short: int | None = None) -> DataFrame:
    """Noise in dB relative to speech of power(file_id, i, band, power).

    The floor of a band is its minimum over ``width`` frames, times ``bias``; noise is the 90th
    percentile of the floors' sum, speech the median power of speech(file_id, i), the frames of speech.
    Files of at most ``width`` frames have no level, unless ``short`` is given: then those of at least
    so many frames have minima over half of their frames, others a level of -90.
    """
    by_band = Window.partitionBy("file_id", "band").orderBy("i").rowsBetween(0, width - 1)
    long = power if short is None else power.join(power.groupBy("file_id").agg(F.count_distinct("i").alias("_frames")), "file_id")
    lows = long.withColumns({"low": F.min("power").over(by_band), "_n": F.count("*").over(by_band)}).where(F.col("_n") == width)
    if short is not None:
        brief = long.where(F.col("_frames") <= width)
        lows = lows.where(F.col("_frames") > width).select("file_id", "i", "band", "low").unionByName(_short_minimum(brief.where(F.col("_frames") >= short), width))
        least = brief.where(F.col("_frames") < short).select("file_id").distinct().withColumn("noise_level_db", F.lit(-90.0))
    floor = lows.groupBy("file_id", "i").agg((F.sum("low") * bias).alias("floor")).groupBy("file_id").agg(F.percentile("floor", 0.9).alias("noise"))
    frame = power.groupBy("file_id", "i").agg(F.sum("power").alias("power")).join(speech.select("file_id", "i"), ["file_id", "i"], "left_semi")
    spoken = frame.groupBy("file_id").agg(F.percentile("power", 0.5).alias("speech"))
    db = lambda c: 10.0 * F.log10(F.col(c) + 1e-30)
    level = F.greatest(F.lit(-90.0), F.least(F.lit(0.0), db("noise") - db("speech")))
    found = floor.join(spoken, "file_id", "left").select("file_id", F.when(F.col("speech").isNull(), -90.0).otherwise(level).alias("noise_level_db"))
    return found if short is None else found.unionByName(least)
