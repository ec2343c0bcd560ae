"""Vectors at length 1 take time in proportion to their dimensions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from recordlens.operators.clusters import unit


def test_long_vectors(spark):
    dims = 30_000  # evaluated anew for each dimension, the length alone took some 2 billion steps
    began = time.monotonic()
    row = spark.range(1, 3).select(unit(F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: (k * F.col("id")).cast("double"))).alias("x")).orderBy("x").first()
    assert time.monotonic() - began < 20
    k = np.arange(1.0, dims + 1)
    assert row["x"] == pytest.approx((k / np.sqrt(k @ k)).tolist())


def test_zero_null_and_empty(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, []), (3, [3.0, 4.0])], "k int, a array<double>")
    assert [r["x"] for r in rows.orderBy("k").select(unit(F.col("a")).alias("x")).collect()] == [[0.0, 0.0], None, [], [0.6, 0.8]]
