import math
import random

import numpy as np
import pytest

from sparwood.functions import wkt
from sparwood.operators import places, shapes, spatial


def test_place_of_all_kinds(spark):
    rows = [
        ("POINT (500000.5 6500000)", (500000.5, 6500000.0)), (" point( 1  2 )", (1.0, 2.0)), ("SRID=3301;POINT(3 4)", (3.0, 4.0)), ("POINT Z (1 2 9)", (1.0, 2.0)),
        ("POINT (9 5)", (5.0, 9.0)), ("MULTIPOINT ((1 3))", (1.0, 3.0)), ("LINESTRING (0 10, 4 10)", (2.0, 10.0)),
        ("POLYGON ((0 10, 4 10, 4 14, 0 14, 0 10))", (2.0, 12.0)), ("POLYGON ((0 10,4 10,4 14,0 14,0 10),(1 11,1 12,2 12,2 11,1 11))", (2 + 0.5 / 15, 12 + 0.5 / 15)),
        ("MULTIPOLYGON (((0 10, 2 10, 2 12, 0 12, 0 10)), ((4 10, 6 10, 6 12, 4 12, 4 10)))", (3.0, 11.0)),
        ("POLYGON EMPTY", None), ("POINT EMPTY", None), ("", None), (None, None), ("nonsense", None), ("POINT (x 1)", None),
    ]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "i int, g string").select("i", wkt.place("g").alias("p"))
    for r in df.collect():
        want = rows[r.i][1]
        got = None if r.p is None or r.p.x is None or math.isnan(r.p.x) else (r.p.x, r.p.y)
        assert got == (pytest.approx(want) if want else None), rows[r.i]


def _points(spark, pts, extra=""):
    return spark.createDataFrame(pts, "pid bigint, x double, y double" + extra)


def test_near_pairs_equal_brute_force_and_exclude_the_exact_radius(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(400)]
    pts += [(1000, 0.0, 0.0), (1001, 400.0, 0.0), (1002, 0.0, 0.0), (1003, None, 0.0), (1004, float("nan"), 1.0)]
    got = {(r.pid_a, r.pid_b) for r in spatial.near_pairs(_points(spark, pts), 400.0, []).collect()}
    ok = [p for p in pts if p[1] is not None and not math.isnan(p[1])]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 160000}
    assert got == want and (1000, 1001) not in got and (1000, 1002) in got
    with_edge = {(r.pid_a, r.pid_b) for r in spatial.near_pairs(_points(spark, pts), 400.0, [], inclusive=True).collect()}
    assert (1000, 1001) in with_edge


def test_nearest_with_ties_far_points_and_no_segments(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(200)] + [(900, 9e5, 9e5), (901, None, 1.0)]
    seg = [(k, rng.uniform(0, 9000), rng.uniform(0, 9000), rng.uniform(0, 9000), rng.uniform(0, 9000)) for k in range(60)]
    seg += [(k + 100, *s) for k, *s in seg]  # every segment under two ids
    segments = spark.createDataFrame(seg, "k bigint, x1 double, y1 double, x2 double, y2 double")
    got = {r.pid: (r.k, r.distance) for r in spatial.nearest(_points(spark, pts), segments, "k").collect()}
    assert len(got) == len(pts) and got[901] == (None, None)

    def dist(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - x1 - t * dx, py - y1 - t * dy)

    for i, x, y in pts[:-1]:
        d, k = min((round(dist(x, y, *s), 3), k) for k, *s in seg)
        assert got[i][0] == k and got[i][1] == pytest.approx(d, abs=1e-3)
    none = spatial.nearest(_points(spark, pts[:3]), segments.where("k < 0"), "k").collect()
    assert [(r.k, r.distance) for r in none] == [(None, None)] * 3


def test_containing_with_holes_corners_and_borders(spark):
    square = "POLYGON ((0 0, 1000 0, 1000 1000, 0 1000, 0 0), (400 400, 600 400, 600 600, 400 600, 400 400))"
    regions = spark.createDataFrame([(7, square), (9, "POLYGON ((2000 0, 3000 1000, 2000 2000, 2000 0))"), (5, None)], "k int, g string")
    pts = [(1, 500.0, 100.0), (2, 500.0, 500.0), (3, 0.0, 0.0), (4, 1000.0, 500.0), (5, 400.0, 500.0), (6, 1500.0, 1000.0), (7, 2999.0, 1000.0), (8, 2001.0, 1.0), (9, 2500.0, 100.0), (10, -5.0, 1000.0)]
    got = {r.pid: r.k for r in spatial.containing(_points(spark, pts), spatial.edges_of(regions, "k", "g"), "k", strip=300.0).collect()}
    assert got == {1: 7, 3: 7, 4: 7, 5: 7, 7: 9, 8: 9}


def test_p1_on_nulls_ties_and_clashing_columns(spark):
    cols = "candidate_id bigint, run_id int, species string, macrocluster_id int, suppressed_by_id string, suppression_distance_m double, id_a bigint, id_b bigint, geometry string, p string, x double, sp int"
    rows = [
        (1, 1, "Porcini ", None, None, None, 10, 11, "POINT (500 600)", None, 0.0, 1), (2, 1, "porcini", 3, "10_11", None, 12, 13, "POINT (500 700)", "p", 1.0, 1),
        (3, 1, "porcini", 3, "10_11", 300.0, 14, 15, "POINT (500 900)", "p", 1.0, 1), (4, 1, None, 3, None, None, None, None, "POINT (500 600)", "p", 1.0, 1),
        (5, 2, "porcini", 3, "10_11", 1.0, 1, 2, None, "p", 1.0, 1), (6, 1, "porcini", 3, "10_11", None, 10, 11, "POINT (500 600)", "p", 1.0, 1),
    ]
    c = places.candidate_places(spark.createDataFrame(rows, cols))
    assert {tuple(r) for r in places.near(c).collect()} == {(1, 2), (1, 3), (1, 6), (2, 3), (2, 6), (3, 6)}
    assert {tuple(r) for r in places.suppressed(c).collect()} == {(2, 1), (6, 1)}
    empty = places.candidate_places(spark.createDataFrame([], cols))
    assert places.near(empty).count() == places.suppressed(empty).count() == 0


def test_contacts_of_boxes(spark):
    def box(i, x, y):
        return (i, [(x, y), (x + 100.0, y), (x + 100.0, y + 100), (x, y + 100)])

    rows = [box(1, 0.0, 0.0), box(2, 100.0, 0.0), box(3, 205.0, 0.0), box(4, 305.0, 100.0), box(5, 1000.0, 0.0), (6, None)]
    df = spark.createDataFrame(rows, "id bigint, ring array<struct<x: double, y: double>>")
    got = {(r.id_a, r.id_b): (r.adjacency_type, r.length_m, r.gap_m) for r in shapes.adjacency(df).collect()}
    assert got == {(1, 2): ("touching", pytest.approx(100.0), 0.0), (2, 3): ("near_gap", pytest.approx(171.47888553998501), pytest.approx(5.0))}


def test_extent_is_the_largest_distance(spark):
    rng = random.Random(3)
    pts = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(5) for _ in range(50)] + [(9, 1.0, 1.0), (10, None, 1.0)]
    got = {r.k: r.extent_m for r in shapes.group_extent(spark.createDataFrame(pts, "k int, x double, y double"), "k").collect()}
    for k in range(5):
        g = [p[1:] for p in pts if p[0] == k]
        assert got[k] == pytest.approx(max(math.dist(a, b) for a in g for b in g))
    assert got[9] == 0.0 and 10 not in got


def test_far_points_meet_few_segments_and_hot_cells_are_whole(spark):
    rng = random.Random(5)
    seg = [(k, x := rng.uniform(0, 500), y := rng.uniform(0, 500), x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for k in range(300)]
    seg += [(-5, 7e5, 0.0, 8e5, 0.0), (301, 250.0, 250.0, 250.0, 250.0), (300, 250.0, 250.0, 250.0, 250.0)]
    pts = [(i, 1e6 + rng.uniform(0, 500), 1e6 + rng.uniform(0, 500)) for i in range(300)] + [(500 + i, rng.uniform(-4e5, 9e5), rng.uniform(-4e5, 9e5)) for i in range(100)]
    pts += [(900, 250.0, 250.0), (901, 250.0, 250.0)]
    segments = spark.createDataFrame(seg, "k bigint, x1 double, y1 double, x2 double, y2 double")
    for size in (None, 20.0):
        got = {r.pid: (r.k, r.distance) for r in spatial.nearest(_points(spark, pts), segments, "k", size).collect()}
        for i, x, y in pts:
            best = min(_distance(x, y, *s) for _, *s in seg)
            assert got[i][1] == pytest.approx(best, abs=1e-6)
            assert round(_distance(x, y, *next(s for k, *s in seg if k == got[i][0])), 3) == round(best, 3)
        assert got[900][0] == got[901][0] == 300 and len(got) == len(pts)
    named = segments.selectExpr("concat('r', k) AS k", "x1", "y1", "x2", "y2")
    assert {r.pid: r.distance for r in spatial.nearest(_points(spark, pts), named, "k").collect()} == {k: v[1] for k, v in got.items()}


def _distance(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / ((dx * dx + dy * dy) or 1)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def test_lines_apart_from_points(spark):
    rng = random.Random(6)
    seg = [(k % 40, *(rng.uniform(0, 3000) for _ in range(4))) for k in range(60)]
    pts = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(10)] + [(99, None, 1.0)]
    segments = spark.createDataFrame(seg, "k bigint, x1 double, y1 double, x2 double, y2 double")
    points = _points(spark, pts).withColumnRenamed("pid", "oid")
    got = {r.k for r in spatial.lines_apart(segments, "k", points, 60.0).collect()}
    assert got == {k for k, *_ in seg} - {k for k, *s in seg for _, x, y in pts[:-1] if _distance(x, y, *s) <= 60}
    assert 0 < len(got) < 40 and spatial.lines_apart(segments, "k", points.where("oid < 0"), 60.0).count() == 40


def test_union_equals_counting_points():
    rng = np.random.default_rng(0)
    for n in (1, 2, 20):
        rings = [shapes.hull(rng.random((7, 2)) * 30 + rng.random(2) * 40) for _ in range(n)] + [np.array([[0, 0], [5, 5]])]
        out = shapes.union([[r] for r in rings])
        pts = rng.random((4000, 2)) * 70
        inside = np.array([any(shapes.inside(p, r) for r in rings) for p in pts])
        assert (inside == (sum(np.array([shapes.inside(p, r) for p in pts]).astype(int) for r in out) % 2 == 1)).mean() > 0.999
        again = shapes.union([[r] for r in rings] + [out])
        assert sum(map(shapes.signed_area, again)) == pytest.approx(sum(map(shapes.signed_area, out)), abs=1e-3)
    box = lambda x, y, w=10.0: np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w]])
    ring = shapes.union([[box(x, y)] for x in (0, 10, 20) for y in (0, 10, 20) if (x, y) != (10, 10)])
    assert sorted(map(shapes.signed_area, ring)) == [-100.0, 900.0] and shapes.text(ring).count("((") == 1
    assert shapes.text(shapes.union([[box(0, 0)], [box(10, 10)]])).count("((") == 2 and shapes.union([]) == []
    assert sum(map(shapes.signed_area, shapes.buffer([box(0, 0, 100.0)], 10))) == pytest.approx(14000 + math.pi * 100, rel=1e-3)
    line = shapes.buffer([np.array([[0.0, 0], [100, 0]])], 40, closed=False)
    assert sum(map(shapes.signed_area, line)) == pytest.approx(8000 + math.pi * 1600, rel=2e-3)


def test_dissolved_groups_and_buffered_lines(spark):
    box = lambda x, y: [(x, y), (x + 100.0, y), (x + 100.0, y + 100), (x, y + 100)]
    rows = [(1, box(0.0, 0.0), 1), (1, box(100.0, 50.0), 1), (1, box(40.0, 20.0), 1), (1, box(0.0, 0.0), 1), (2, box(0.0, 0.0), 1), (2, box(9e4, 0.0), 1), (3, None, 1), (4, [(0.0, 0.0)], 1), (None, box(0.0, 0.0), 1)]
    df = spark.createDataFrame(rows, "g int, ring array<struct<x: double, y: double>>, cx int")
    for size in (5000.0, 60.0):
        got = {r.g: (r.area_m2, r.perimeter_m, r.outline.count("((")) for r in shapes.dissolve(df, "g", size).collect()}
        assert got == {1: (pytest.approx(10000 + 10000 + 1200 + 1200), pytest.approx(2 * (200 + 150)), 1), 2: (pytest.approx(20000), pytest.approx(800), 2)}
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(5.0, 5.0)]), (3, []), (4, None)], "k int, line array<struct<x: double, y: double>>")
    got = {r.k: r.area_m2 for r in shapes.buffered_lines(lines, "k").collect()}
    assert got == {1: pytest.approx(8000 + math.pi * 1600, rel=2e-3), 2: pytest.approx(math.pi * 1600, rel=2e-3)}


def test_contacts_of_parts_and_concave_stands(spark):
    box = lambda x, y, w=100.0: np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w]])
    bent = np.array([[0, 0], [100, 0], [100, 10], [10, 10], [10, 100], [0, 100]], float)
    kind, length, gap = shapes.classify([bent], [box(15, 15, 50.0)])
    xs = np.arange(-11, 110, 0.5) + 0.25
    both = sum(int((_close(xs, y, bent) & _close(xs, y, box(15, 15, 50.0))).sum()) for y in xs) * 0.25
    assert (kind, gap) == ("near_gap", 5.0) and length == pytest.approx(both / 10, rel=0.01)
    # Contacts of parts add up: 12 m and 12 m are a contact, each alone is none.
    a, b, c = box(0, 0, 12.0), box(0, 1000, 12.0), np.vstack([[12, 0], [20, 0], [20, 1100], [12, 1100]]).astype(float)
    assert shapes.classify([a], [c]) is None and shapes.classify([a, b], [c]) == ("touching", pytest.approx(24.0), 0.0)
    parts = lambda rings: [[(float(x), float(y)) for x, y in r] for r in rings]
    df = spark.createDataFrame([(1, parts([a, b]), 0), (2, parts([c]), 0), (3, [], 0), (4, None, 0)], "id bigint, parts array<array<struct<x: double, y: double>>>, x0 int")
    assert [(r.id_a, r.id_b, r.length_m) for r in shapes.adjacency(df).collect()] == [(1, 2, pytest.approx(24.0))]


def _close(xs, y, ring):
    s = shapes.segments(ring)
    return np.array([shapes.inside(np.array([x, y]), ring) or shapes._point_to_segments(np.array([x, y]), s).min() <= 10 for x in xs])
