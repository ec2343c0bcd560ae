"""Helpers shared by the operators: shared-folder cuts, table access and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary one is made if it
    is unset; on a cluster that is an error, since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder is None and held.isDefined():
        folder = held.get()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="recordlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and forget its lineage; the files outlive lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, as a Parquet table of the shared folder: smaller on disk, and later reads take single columns.

    The folder is returned too, to be removed once the table is read no more.
    """
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def write_bytes(spark: SparkSession, place: str, content: bytes) -> None:
    """Writes one small file wherever the session's file systems reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def remove_folder(spark: SparkSession, place: str) -> None:
    """Deletes a folder that this session wrote, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round of star contraction over edges (u, v) with u > v."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(low, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``: rows ``(node, component)``.

    ``component`` is the smallest node that can be reached. Nodes without an edge to another
    node do not appear. Alternating large-star and small-star contraction: each round is two
    joins on a minimum that is pre-aggregated on the map side, so a hub's edges are never
    gathered in one row, and AQE may split its partition. Each round is cut in the shared
    folder. An empty or null-only edge table gives no rows.
    """
    flat = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(flat.where("u > v").distinct())
    state = None
    for _ in range(max_rounds):
        digest = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if tuple(digest) == state or digest["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        state = tuple(digest)
        now = cut(_stars(_stars(now, True), False))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def least_labels(i, j, n: int):
    """Smallest reachable position of each of ``n`` positions over the pairs (i, j) (numpy)."""
    import numpy as np

    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
