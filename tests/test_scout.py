import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparwood.functions import crs
from sparwood.functions import scoring as S
from sparwood.operators import components, composition, ordering, partition, rain, suppression
from sparwood.operators import shortlist as L


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_projection_of_a_known_point_and_back(spark):
    x, y = crs.forward(F.lit(24.75), F.lit(59.43))
    assert _one(spark, x) == pytest.approx(542549, abs=1500) and _one(spark, y) == pytest.approx(6588500, abs=1500)
    lon, lat = crs.inverse(x, y)
    assert _one(spark, lon) == pytest.approx(24.75, abs=1e-10) and _one(spark, lat) == pytest.approx(59.43, abs=1e-10)
    with pytest.raises(ValueError):
        crs.annulus(F.lit(0), F.lit(0), 0, 0, 5, 5)


def test_scores_of_known_values_and_nulls(spark):
    null = F.lit(None).cast("double")
    assert _one(spark, S.temperature_curve(F.lit(5.0))) == pytest.approx(0.7)
    assert _one(spark, S.temperature_curve(F.lit(22.0))) == pytest.approx(0.7)
    assert _one(spark, S.frost_guard(F.lit(0.0))) == pytest.approx(0.8)
    assert _one(spark, S.temperature_modifier(F.lit(12.0), null)) is None
    assert _one(spark, S.persistence_modifier(F.lit(90.0), F.lit(0.0), null)) == pytest.approx(0.8)
    assert _one(spark, S.access_score(null)) == 0.0 and _one(spark, S.access_score(F.lit(750.0))) == 0.5
    assert _one(spark, S.access_reason(F.lit(82.5), F.lit("Rada"))) == "82m from Rada-class road"
    assert _one(spark, S.worst_quality(F.lit("complete"), F.lit("b"))) == "b"
    assert _one(spark, S.ecotone_score(F.lit(0.5), null, F.lit(0.1))) is None
    assert _one(spark, S.rain_bin(F.lit(5.0), F.lit(5.0 + 1e-9))) == 0.0
    with pytest.raises(Exception, match="longer window"):
        _one(spark, S.rain_bin(F.lit(4.0), F.lit(5.0)))
    with pytest.raises(Exception, match="unknown type"):
        _one(spark, S.car_class(F.lit("Muu tee"), F.lit(None).cast("string")))
    assert S.season_prior("porcini", "01-01") == 0.10 and S.season_prior("porcini", "08-20") == 1.0
    assert S.season_prior("chanterelle", "06-08") == pytest.approx(0.225)
    with pytest.raises(Exception, match="coverage outside"):
        _one(spark, S.coverage(F.lit(1.004)))
    assert _one(spark, S.coverage(null)) == 0.0 and _one(spark, S.known_car_class(F.lit("Muu tee"), F.lit(None).cast("string"))) is None
    assert _one(spark, S.boolean(F.lit("False"))) is False and _one(spark, S.boolean(F.lit("no"))) is None


def test_rain_events_equal_a_fold(spark):
    rng = random.Random(6)
    now = datetime(2024, 1, 31)
    rows = [(px, now - timedelta(hours=rng.uniform(0, 14 * 24)), rng.choice([None, 0.0, rng.uniform(0, 30)])) for px in range(20) for _ in range(40)]
    base = now - timedelta(days=2)
    rows += [(99, base, 4.0), (99, base + timedelta(hours=6), 4.0), (99, base + timedelta(hours=12, seconds=1), 4.0), (99, now, 99.0)]
    df = spark.createDataFrame(rows, "px bigint, ts timestamp_ntz, rate double")
    got = {(r.px, r.event_no): (r.slots, round(r.event_mm, 6)) for r in rain.events(df, "2024-01-31 00:00:00").collect()}
    want, last = {}, {}
    for px, ts, rate in sorted((r for r in rows if r[2] and r[1] < now), key=lambda r: r[:2]):
        n, prev = last.get(px, (0, None))
        n += prev is None or ts - prev > timedelta(hours=6)
        last[px] = (n, ts)
        s, mm = want.get((px, n), (0, 0.0))
        want[px, n] = (s + 1, mm + rate / 4)
    assert got == {k: (s, round(mm, 6)) for k, (s, mm) in want.items()} and got[99, 1][0] == 2
    day = {r.px: r.max_24h_rain_14d for r in rain.max_24h(df, "2024-01-31 00:00:00").collect()}
    for px in range(20):
        own = [(t, (r or 0) / 4) for p, t, r in rows if p == px]
        assert day[px] == pytest.approx(max(sum(m for u, m in own if timedelta(0) <= t - u <= timedelta(hours=24)) for t, _ in own))


def test_components_and_numbers(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, None), (1, 99999)]
    nodes = [(k,) for k in [*range(300), *range(1000, 1101)]]
    v, e = spark.createDataFrame(nodes, "id bigint"), spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    parent = {k: k for k, in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    comp = components.components(v, e)
    assert {r.id: r.root for r in comp.collect()} == {k: find(k) for k in parent}
    numbers = {r.root: r.block_id for r in components.numbered(comp).select("root", "block_id").distinct().collect()}
    assert numbers == {r: i for i, r in enumerate(sorted(set(map(find, parent))))}


def test_linkage_equals_brute_force_and_partition_is_connected():
    rng = np.random.default_rng(8)
    p = rng.random((40, 2)) * 100
    label = partition.complete_linkage(p, 35)
    groups = [[i] for i in range(40)]
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    while True:
        m, a, b = min((max(d[i, j] for i in x for j in y), x, y) for k, x in enumerate(groups) for y in groups[:k])
        if m > 35:
            break
        groups.remove(b), a.extend(b)
    assert sorted(map(sorted, groups)) == sorted(np.flatnonzero(label == k).tolist() for k in set(label))
    box = lambda x: np.array([[x, 0], [x + 1000, 0], [x + 1000, 1000], [x, 1000]], float)
    corners = {0: box(0), 1: box(20000), 2: box(40000)}
    centre = {k: c.mean(0) for k, c in corners.items()}
    chain = partition.split([0, 1, 2], centre, corners, {0: {1}, 1: {0, 2}, 2: {1}}, 35000)
    assert len(chain) == 2 and sorted(i for g in chain for i in g) == [0, 1, 2]
    assert sorted(partition.split([0, 1], centre, corners, {}, 35000)) == [[0], [1]]


@pytest.mark.parametrize("tile", [None, 1000.0])
def test_greedy_suppression_equals_brute_force(spark, tile):
    rng = random.Random(9)
    rows = [(i, 1, rng.choice([0.5, rng.random()]), rng.uniform(-3000, 6000), rng.uniform(0, 6000)) for i in range(600)] + [(900, 1, None, 1.0, 1.0), (901, 1, 0.9, None, 1.0), (902, None, 0.9, 1.0, 1.0)]
    # Scores that rise along a line: each point hangs on the next, over many tiles.
    rows += [(1000 + i, 2, i / 100, 150.0 * i, 9.0) for i in range(100)] + [(2000, 3, 0.1, 0.0, 0.0), (2001, 3, 0.1, 0.0, 0.0), (2002, 3, 0.1, 400.0, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, bucket int, score double, x double, y double").withColumn("status", F.lit("clash"))
    got = {r.id: (r.suppressed_by, r.suppressed_m, r.rank_before) for r in suppression.suppress(df, ["bucket"], "score", ["id"], "id", tile=tile).collect()}
    want = {}
    for bucket in (1, 2, 3):
        kept = []
        whole = [r for r in rows if r[1] == bucket and r[2] is not None and r[3] is not None]
        for rank, (i, _, s, x, y) in enumerate(sorted(whole, key=lambda r: (-r[2], r[0])), 1):
            near = min(((math.dist((x, y), k[1:]), n, k[0]) for n, k in enumerate(kept)), default=(9e9, 0, None))
            want[i] = (near[2], near[0], rank) if near[0] < 400 else (None, None, rank)
            if near[0] >= 400:
                kept.append((i, x, y))
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1]) if v[1] is not None else want[k][1] is None for k, v in got.items())
    assert suppression.suppress(df.where("id < 0"), ["bucket"], "score", ["id"], "id").count() == 0


def test_places_in_an_order_with_groups_and_nulls(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, 1.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g int, v double")
    key = lambda r: (r[2] is None, r[2] or 0, r[0])
    got = {r.id: r.n for r in ordering.numbered_rows(df, [F.col("v").asc_nulls_last(), F.col("id")], "n", ["g"]).collect()}
    assert got == {r[0]: n for g in (1, 2, None) for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=key), 1)}
    got = {r.id: r.n for r in ordering.numbered_rows(df, [F.col("v").asc_nulls_last(), F.col("id")], "n").collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}
    assert ordering.numbered_rows(df.where("id < 0"), [F.col("id")], "n", ["g"]).count() == 0


def test_compositions_and_keys_are_attached(spark):
    stands = spark.createDataFrame([(1, "old"), (2, None), (None, None)], "id bigint, composition string")
    elements = spark.createDataFrame([(1, "MA", 40.0), (1, "KU", float("nan")), (1, "MA", None), (7, "MA", 1.0)], "id bigint, code string, share double")
    got = {r.id: [tuple(e) for e in r.composition] for r in composition.attached(stands, elements, "id", ["code", "share"]).collect()}
    assert got[2] == [] and got[None] == [] and [e[0] for e in got[1]] == ["KU", "MA", "MA"]
    values = spark.createDataFrame([(1, 5)], "id bigint, block_id int")
    once = components.with_key(stands, values, "id")
    assert {r.id: r.block_id for r in components.with_key(once, values, "id").collect()} == {1: 5, 2: None, None: None}


def test_stages_are_kept_and_read_by_the_next(spark, tmp_path):
    from sparwood.plans import pipeline, scout

    folder, out = "/root/testdata/sf0.001", str(tmp_path)
    took = pipeline.run(spark, folder, out)
    assert list(took) == list(pipeline.BUILD)
    state = sorted(map(tuple, spark.read.parquet(f"{out}/state").select("region", "cross_count", "porcini_ranked_count").collect()))
    assert state == sorted(map(tuple, scout.daily_state_rollup(spark, folder).select("region", "cross_count", "porcini_ranked_count").collect()))
    # What an earlier run left is read, not built anew.
    assert list(pipeline.run(spark, folder, out, skip=tuple(n for n in pipeline.BUILD if n != "remote"))) == ["remote"]


def test_joins_of_two_stands(spark):
    edges = spark.createDataFrame([(1, 2), (1, 9), (8, 9)], "id_a bigint, id_b bigint")
    access = spark.createDataFrame([(1, 0.5, "NORMAL", "a", 750.0), (2, 0.5, "CONDITIONAL", "b", 750.0), (8, None, None, "none", None)], "id bigint, access_score double, access_confidence string, access_reason string, nearest_car_road_m double")
    got = {(r.id_a, r.id_b): (r.access_modifier, r.access_reason, r.scout_eligible) for r in L.best_access(edges, access).collect()}
    assert got == {(1, 2): (0.5, "a", True), (1, 9): (0.5, "a", True), (8, 9): (0.0, "none", False)}
    w = spark.createDataFrame([(1, 0.8, "complete", 1.0), (2, 0.4, "x", 0.5), (9, None, "y", 0.1)], "id bigint, fruiting_porcini double, quality string, coverage double").withColumn("as_of", F.lit(None).cast("timestamp_ntz"))
    got = {(r.id_a, r.id_b): (r.fruiting_porcini, r.fruiting_chanterelle, r.weather_quality) for r in L.mean_fruiting(edges, w).collect()}
    assert got[1, 2] == (pytest.approx(0.6), None, "x") and got[1, 9][0] is None and got[8, 9] == (None, None, None)
    with pytest.raises(Exception, match="without region"):
        L.with_region(edges, spark.createDataFrame([(1, 4)], "id bigint, region int")).collect()
