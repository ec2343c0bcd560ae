"""Speaker clusters of embedded windows: centroids, separation and the rules about small clusters."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.windows import even_sample
from recordlens.shared import cut

# The least share and number of windows of a cluster, and the least separation of two speakers.
LEAST_SHARE, LEAST_WINDOWS, LEAST_SEPARATION = 0.12, 2, 0.22
# Windows of a file that count at most, and vectors of a file with two clusters at least.
MOST_WINDOWS, LEAST_VECTORS = 240, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """``a`` at length 1. It and its length are bound once a row: inside the last lambda they would be evaluated anew for each dimension."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return once(a, lambda v: once(F.sqrt(dot(v, v)), lambda size: F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(1.0))))


def centroids(windows: DataFrame, *keys: str) -> DataFrame:
    """Unit centroids of windows(keys, embedding): the mean of each dimension, aggregated before the shuffle."""
    long = windows.select(*keys, F.posexplode("embedding").alias("dim", "x"))
    means = long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("centroid"))
    return gathered.withColumn("centroid", unit(F.col("centroid")))


def separation(pairs: DataFrame, a: str, b: str) -> Column:
    return 1.0 - dot(F.col(a), F.col(b))


def collapse_small(windows: DataFrame) -> DataFrame:
    """windows(file_id, cluster): one cluster where any has too few windows of its file."""
    own = windows.groupBy("file_id", "cluster").agg(F.count("*").alias("n"))
    rules = own.groupBy("file_id").agg(F.min("n").alias("least"), F.sum("n").alias("all"), F.count("*").alias("clusters"))
    keep = (F.col("clusters") >= 2) & (F.col("least") >= F.greatest(F.lit(float(LEAST_WINDOWS)), LEAST_SHARE * F.col("all")))
    return windows.join(rules.select("file_id", keep.alias("keep")), "file_id").withColumn("cluster", F.when(F.col("keep"), F.col("cluster")).otherwise(0)).drop("keep")


def _starts(windows: DataFrame, starts: int) -> DataFrame:
    """``(file_id, start, a, b)``: evenly spaced vectors of each file, each with the one farthest from it."""
    whole = Window.partitionBy("file_id")
    placed = windows.withColumns({"_n": F.count("*").over(whole), "_r": F.row_number().over(whole.orderBy("id")) - 1})
    last, steps = F.col("_n") - 1, F.least(F.col("_n"), F.lit(starts)) - 1
    k = F.when(last > 0, F.ceil(F.col("_r") * steps / last.cast("double"))).otherwise(0)  # row r starts if some k has floor(k * last / steps) = r
    first = F.when(steps > 0, F.floor(k * last / steps.cast("double"))).otherwise(0)
    seeds = placed.where(first == F.col("_r")).select("file_id", F.col("_r").alias("start"), F.col("x").alias("a"))
    near = windows.join(seeds, "file_id").withColumn("_d", dot(F.col("x"), F.col("a")))
    return near.groupBy("file_id", "start").agg(F.first("a").alias("a"), F.min_by("x", F.struct("_d", "id")).alias("b"))


def _assigned(windows: DataFrame, state: DataFrame) -> DataFrame:
    """Each vector with each of its file's pairs of middles, and the side it is on."""
    both = windows.join(state, "file_id").withColumns({"_a": dot(F.col("x"), F.col("a")), "_b": dot(F.col("x"), F.col("b"))})
    return both.withColumn("side", (F.col("_b") > F.col("_a")).cast("int"))


def _centred(windows: DataFrame, state: DataFrame) -> DataFrame:
    """The middles of the sides; a side without vectors keeps its own. Sums are aggregated before the shuffle."""
    means = _assigned(windows, state).groupBy("file_id", "start", "side").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    found = means.groupBy("file_id", "start").agg(of(0).alias("_m0"), of(1).alias("_m1"))
    new = lambda mean, old: F.when(F.col(mean).isNotNull(), unit(F.col(mean))).otherwise(F.col(old)).alias(old)
    return state.join(found, ["file_id", "start"]).select("file_id", "start", new("_m0", "a"), new("_m1", "b"))


def two_means(windows: DataFrame, starts: int = 10, rounds: int = 50) -> DataFrame:
    """(file_id, id, cluster) of windows(file_id, id, embedding): two clusters a file by cosine; 0 holds the smallest id.

    All files go through the rounds together: each vector meets the middles of its file's starts,
    sides are averaged, until no middle moves or after ``rounds``. Of the starts the one whose vectors lie
    closest to their middles counts, of equal ones the first. No file is one group. Null ids and
    embeddings are not expected; equal ids of a file get one cluster each.
    """
    x = windows.select("file_id", "id", unit(F.col("embedding").cast("array<double>")).alias("x"))
    state = cut(_starts(x, starts))
    moved = None
    for _ in range(rounds):
        new = cut(_centred(x, state))
        digest = new.agg(F.sum(F.xxhash64("file_id", "start", F.transform("a", lambda v: F.round(v, 9)), F.transform("b", lambda v: F.round(v, 9))).cast("decimal(20,0)")).alias("h")).first()["h"]
        state = new
        if digest == moved:
            break
        moved = digest
    sided = _assigned(x, state)
    totals = sided.groupBy("file_id", "start").agg(F.sum(F.greatest("_a", "_b")).alias("total"))
    order = Window.partitionBy("file_id").orderBy(F.round("total", 9).desc(), "start")
    best = totals.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("file_id", "start")
    chosen = sided.join(best, ["file_id", "start"]).select("file_id", "id", "side")
    first = chosen.groupBy("file_id").agg(F.min_by("side", "id").alias("_first"))
    return chosen.join(first, "file_id").select("file_id", "id", F.abs(F.col("side") - F.col("_first")).cast("int").alias("cluster"))


def speakers(windows: DataFrame, separate: bool = True, most: int = MOST_WINDOWS, **more: int) -> DataFrame:
    """(file_id, id, cluster, separation): clusters of ``two_means`` after the rules.

    At most ``most`` windows of a file count, evenly spaced by id. Files of fewer than LEAST_VECTORS have one
    cluster; small clusters become one, and with ``separate`` clusters that lie too close.
    """
    order = Window.partitionBy("file_id").orderBy("id")
    sample = even_sample(windows.select("file_id", "id", "embedding").withColumn("i", F.row_number().over(order)), most).drop("i")
    sample = cut(sample)
    found = cut(collapse_small(two_means(sample, **more)).join(sample, ["file_id", "id"]))
    middle = centroids(found, "file_id", "cluster")
    both = middle.where("cluster = 0").select("file_id", F.col("centroid").alias("a")).join(middle.where("cluster = 1").select("file_id", F.col("centroid").alias("b")), "file_id")
    apart = both.select("file_id", separation(both, "a", "b").alias("separation"))
    joined = found.drop("embedding").join(apart, "file_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("file_id")))
    one = (F.col("_n") < LEAST_VECTORS) | F.col("separation").isNull()
    if separate:
        one = one | (F.col("separation") < LEAST_SEPARATION)
    return joined.select("file_id", "id", F.when(one, 0).otherwise(F.col("cluster")).alias("cluster"), F.when(F.col("_n") >= LEAST_VECTORS, F.col("separation")).alias("separation"))
