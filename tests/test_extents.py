"""Extents of groups: many small ones in bounded time, large ones by their corners."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparwood.operators import shapes


def test_many_small_groups_take_array_time(spark):
    n = 40_000
    x, y = (F.col("id") * 7919 % 20011).cast("double"), (F.col("id") * 104729 % 20021).cast("double")
    df = spark.range(0, 10 * n, 1, 8).select((F.col("id") % n).alias("g"), x.alias("x"), y.alias("y"))
    began = time.time()
    got = dict(map(tuple, shapes.group_extent(df, "g").collect()))
    took = time.time() - began
    i = np.arange(10 * n).reshape(10, n)
    p = np.stack([i * 7919 % 20011, i * 104729 % 20021], -1).astype(float)
    want = np.max([np.hypot(*(p - np.roll(p, k, 0)).transpose(2, 0, 1)).max(0) for k in range(1, 6)], 0)
    assert len(got) == n and all(abs(got[g] - want[g]) < 1e-9 for g in range(n))
    assert took < 30


def test_large_and_odd_groups(spark):
    rng = np.random.default_rng(6)
    wide = spark.range(0, 700_000, 1, 3).select(F.lit("wide").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("x"), (F.col("id") * 104729 % 20021).cast("double").alias("y"))
    few = [("one", 1.0, 2.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0), ("gap", None, 1.0), ("gap", 1.0, float("nan")), ("half", 0.0, 0.0), ("half", None, 9.0), ("half", 3.0, 4.0), (None, 0.0, 0.0), (None, 9.0, 0.0)]
    line = [("line", 6.5e6 + k, 5e5 + 2.0 * k) for k in rng.permutation(900).tolist()]
    df = wide.union(spark.createDataFrame(few + line, "g string, x double, y double"))
    got = dict(map(tuple, shapes.group_extent(df, "g").collect()))
    i = np.arange(700_000)
    p = np.stack([i * 7919 % 20011, i * 104729 % 20021], 1).astype(float)
    want = {"one": 0.0, "same": 0.0, "half": 5.0, "line": 899 * 5**0.5, "wide": shapes.extent(p)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert shapes.group_extent(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 256, 257, 1000])
@pytest.mark.parametrize("shape", ["square", "circle", "grid", "line"])
def test_extents_equal_all_pairs(n, shape):
    rng = np.random.default_rng(n)
    a = rng.random((3, n, 2))
    if shape == "circle":
        a = np.stack([np.cos(a[..., 0] * 7), np.sin(a[..., 0] * 7)], -1)
    if shape == "grid":
        a = np.round(a * 5)
    if shape == "line":
        a[..., 1] = 2 * a[..., 0]
    a = a * 20000 + 6.5e6
    want = [max(np.hypot(*(p - q).T).max() for q in p) for p in a]
    got = shapes.extents(*a.reshape(-1, 2).T, np.full(3, n))
    assert np.allclose(got, want, rtol=1e-12, atol=1e-8)
