"""Blocks into clusters: all of them, whatever their number."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sparwood.operators import partition, shapes
from sparwood.plans import scout


def _square(x, y, half=500.0):
    return np.array([[x - half, y - half], [x + half, y - half], [x + half, y + half], [x - half, y + half]])


def test_blocks_are_all_suppliers(spark):
    folder = "/root/testdata/sf0.1"
    assert scout._centres(spark, folder).count() == spark.read.parquet(f"{folder}/supplier.parquet").count() > 401


def test_linkage_holds_no_matrix():
    n, rng = 3000, np.random.default_rng(3)
    tracemalloc.start()
    label = partition.complete_linkage(rng.random((n, 2)) * 60000, 35000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n and 1 < len(set(label)) < 40


def test_clusters_equal_split_with_its_links(spark):
    rng = np.random.default_rng(4)
    p = rng.random((120, 2)) * 60000
    links: dict[int, set[int]] = {}
    pairs = [(i, j) for i in range(120) for j in range(i) if np.hypot(*(p[i] - p[j])) <= 8000]
    for i, j in pairs:
        links.setdefault(i, set()).add(j), links.setdefault(j, set()).add(i)
    want, left = set(), set(range(120))
    while left:
        whole = partition._reachable(sorted(left), links)[0]
        left -= set(whole)
        want |= {tuple(g) for g in partition.split(whole, dict(enumerate(p)), {i: _square(*p[i]) for i in whole}, links, 35000)}
    blocks = spark.createDataFrame([(i, float(x), float(y), [{"x": float(u), "y": float(v)} for u, v in _square(x, y)]) for i, (x, y) in enumerate(p)], "block_id bigint, x double, y double, corners array<struct<x: double, y: double>>")
    got = partition.clusters(blocks, spark.createDataFrame(pairs, "id_a bigint, id_b bigint"), 35000)
    assert {tuple(sorted(r.ids)) for r in got.groupBy("root").agg(F.collect_list("block_id").alias("ids")).collect()} == want


def test_links_go_by_boundaries_of_all_blocks(spark):
    folder = "/root/testdata/sf0.1"
    rows = sorted((r.block_id, r.x, r.y) for r in scout._centres(spark, folder).collect())
    ids, at = [r[0] for r in rows], np.array([r[1:] for r in rows])
    off = np.abs(at[:, None] - at[None])
    gap = np.hypot(*np.maximum(off - 1000, 0).transpose(2, 0, 1))
    want = {(ids[i], ids[j]): gap[i, j] for i, j in zip(*np.nonzero(np.triu(gap <= 8000, 1)))}
    got = {(r.id_a, r.id_b): r.distance_m for r in scout.block_boundary_proximity(spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert len(want) > np.triu(np.hypot(*off.transpose(2, 0, 1)) <= 8000, 1).sum()


def test_near_shapes_equal_distance_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rings = [rng.random(2) * 60 + shapes.hull(rng.random((rng.integers(1, 9), 2)) * rng.choice([1, 6, 30])) for _ in range(90)]
    rings += [np.array([[0, 0], [5, 0], [5, 5]]) + k for k in (200.0, 210.0)] + [np.array([[200.0, 189.0], [205, 189], [202, 180]]), _square(212, 220, 1), _square(200, 200, 0.25)]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)] + [(900, []), (901, None)], "id bigint, ring array<struct<x: double, y: double>>")
    got = {(r.id_a, r.id_b): r.distance_m for r in shapes.near_shapes(df, 11.0).collect()}

    def exact(a, b):
        if len(a) == 1 and len(b) == 1:
            return shapes.distance(a, b)
        if min(len(a), len(b)) == 1:
            p, ring = (a, b) if len(a) == 1 else (b, a)
            return 0.0 if len(ring) > 2 and shapes.inside(p[0], ring) else float(shapes._point_to_segments(p[0], shapes.segments(ring)).min())
        return shapes.distance(a, b)

    want = {(i, j): d for j in range(len(rings)) for i in range(j) if (d := exact(rings[i], rings[j])) <= 11.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and 11.0 in want.values()
