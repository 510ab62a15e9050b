"""Shapes that are their own boxes: measured in the join, equal to the exact distances, in bounded time."""

import time

import numpy as np
from pyspark.sql import functions as F

from sparwood.operators import shapes


def test_many_pairs_of_squares_take_join_time(spark):
    n = 4500
    x, y = (F.col("id") * 6151 % 5003).cast("double"), (F.col("id") * 3571 % 5009).cast("double")
    ring = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (100, 0), (100, 100), (0, 100))])
    began = time.time()
    got = shapes.near_shapes(spark.range(n).select("id", ring.alias("ring")), 8000.0).agg(F.count("*"), F.sum("distance_m")).first()
    took = time.time() - began
    i = np.arange(n)
    off = [np.maximum(np.abs(v[:, None] - v[None]) - 100.0, 0) for v in (i * 6151 % 5003, i * 3571 % 5009)]
    want = np.triu(np.hypot(*off), 1)
    assert got[0] == n * (n - 1) // 2 and abs(got[1] - want.sum()) < 1e-6 * want.sum()
    assert took < 20


def test_boxes_among_other_shapes_equal_exact_distances(spark):
    rng = np.random.default_rng(8)
    rings = []
    for k in range(160):
        x, y, w, h = *rng.integers(0, 90, 2), *rng.integers(0, 9, 2)
        box = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
        rings.append([box, box[::-1], box[1:] + box[:1], [*box, box[0]], box[:2], box[1:3], [box[0], box[2]], box[:3], [box[0], box[2], box[1], box[3]], box[:1], [box[0], [x + w + 1, y], *box[2:]]][k % 11])
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], "id bigint, ring array<struct<x: double, y: double>>")
    got = {(r.id_a, r.id_b): r.distance_m for r in shapes.near_shapes(df, 10.0).collect()}
    of = [np.array(r, float)[None] for r in rings]
    want = {(i, j): d for j in range(len(rings)) for i in range(j) if (d := float(shapes.distances(of[i], of[j])[0])) <= 10.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and 0.0 in want.values() and 10.0 in want.values()
