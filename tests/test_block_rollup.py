"""Stands to blocks without steps over all of them: labels by task, links between tasks, numbers as rows are written."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparwood.operators import components, ordering, shapes
from sparwood.plans import scout


def _roots(ids, pairs):
    low = {i: i for i in ids}
    known = [(a, b) for a, b in pairs if a in low and b in low]
    while any(low[a] != low[b] for a, b in known):
        for a, b in known:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.fixture
def written(monkeypatch):
    names, own = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: names.append(name) or own(df, name))
    return names


def test_components_within_tasks_take_no_star_steps(spark, written):
    n = 60_000
    links = spark.range(0, n, 1, 6).where("id % 5 > 0").select("id", (F.col("id") - 1).alias("to"))
    got = components.components(spark.range(n), links, a="id", b="to")
    assert got.where("root = id - id % 5").count() == got.count() == n
    assert "edges" not in written


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components_across_tasks(spark, kind):
    rng = np.random.default_rng(7)
    ids = [10 + i for i in range(300)]
    pairs = rng.integers(0, 320, (230, 2)).tolist() + [[i, i + 1] for i in range(200, 260)] + [[5, 5], [11, None], [None, 12], [None, None]]
    edges = spark.createDataFrame(pairs, "id_a bigint, id_b bigint").repartition(7, F.rand(1)).select(*[F.col(c).cast(kind) for c in ("id_a", "id_b")])
    name = int if kind == "bigint" else str
    want = _roots([name(i) for i in ids], [(name(a), name(b)) for a, b in pairs if a is not None and b is not None])
    vertices = spark.createDataFrame([(i,) for i in [*ids, *ids[:9], None]], "id bigint").select(F.col("id").cast(kind))
    assert {(r.id, r.root) for r in components.components(vertices, edges).collect()} == set(want.items())
    # Vertices keep their columns; without an edge to a known vertex they have no root.
    met = {v for a, b in pairs if None not in (a, b) and a != b and a in ids and b in ids for v in (name(a), name(b))}
    rows = components.rooted(vertices.where("id IS NOT NULL").distinct().withColumn("x", F.lit(1.5)), edges).collect()
    assert sorted((r.id, r.x, r.root or "") for r in rows) == sorted((i, 1.5, want[i] if i in met else "") for i in want)


@pytest.mark.parametrize("by", [None, ["g"]])
def test_places_over_many_ranges(spark, by):
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(0, 5000, 1, 5).select("id", (F.col("id") * 7919 % 501).alias("v"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 10 > 1).alias("g"))
        placed = ordering.numbered_rows(df, [F.col("v").desc(), F.col("id")], "n", by)
        rows = placed.collect()
        moved = placed._jdf.queryExecution().executedPlan().toString().split("Scan parquet")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want, nth = {}, {}
    for r in sorted(rows, key=lambda r: (-r.v, r.id)):
        g = r.g if by else 0
        want[r.id] = nth[g] = nth.get(g, 0) + 1
    assert len(rows) == 5000 and {r.id: r.n for r in rows} == want
    assert by or not any("Window" in part for part in moved[:1])


def test_counts_beside_extents(spark):
    wide = spark.range(0, 300_000, 1, 3).select(F.lit("wide").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("x"), (F.col("id") * 104729 % 20021).cast("double").alias("y"))
    few = [("one", 1.0, 2.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0), ("half", 0.0, 0.0), ("half", None, 9.0), ("half", 3.0, 4.0), ("gap", None, 1.0)]
    df = wide.union(spark.createDataFrame(few, "g string, x double, y double"))
    got = {r.g: (r.extent_m, r.n_points) for r in shapes.group_extent(df, "g", "n_points").collect()}
    assert {g: n for g, (_, n) in got.items()} == {"wide": 300_000, "one": 1, "same": 2, "half": 2}
    assert {g: e for g, (e, _) in got.items()} == {r.g: r.extent_m for r in shapes.group_extent(df, "g").collect()}
    assert shapes.group_extent(df.limit(0), "g", "n_points").count() == 0


def test_extents_are_roots_of_sums_of_squares():
    d = np.random.default_rng(3).integers(-20020, 20021, (40_000, 2)).astype(float)
    want = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2)
    p = np.stack([d + 6.5e6, np.full_like(d, 6.5e6)], 1)
    assert (shapes.extents(*p.reshape(-1, 2).T, np.full(len(d), 2)) == want).all()
    assert [shapes.extent(q) for q in p[:2000]] == want[:2000].tolist()


def test_rollup_of_odd_orders(spark, tmp_path, written):
    day = datetime.datetime(2020, 1, 1)
    rng = np.random.default_rng(8)
    rows = [(int(k) * 3, int(k) % 90, day + datetime.timedelta(int(rng.integers(0, 2200)))) for k in rng.permutation(900)]
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (None, 3, day), (5000, None, day), (5001, None, day), (5002, 7, None), (5003, 1000, day), (-7, 1001, day), (-6, 1001, day + datetime.timedelta(365))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in scout.block_rollup(spark, str(tmp_path)).collect())
    assert "edges" not in written

    def at(k):  # % keeps the sign of its left side in SQL
        return 500000 + int(np.fmod(k * 7919, 20011)), 6500000 + int(np.fmod(k * 104729, 20021))

    ids = {k for k, _, _ in rows if k is not None}
    pairs = [(r.id_a, r.id_b) for r in scout.view(spark, str(tmp_path), "edge").collect()]
    blocks = {}
    for i, root in _roots(ids, pairs).items():
        blocks.setdefault(root, []).append(at(i))
    assert len(got) == len(blocks) and max(map(len, blocks.values())) > 3
    for (number, n, extent, oversized), (k, root) in zip(got, enumerate(sorted(blocks))):
        p = np.array(blocks[root], float)
        far = max(np.hypot(*(p - q).T).max() for q in p)
        assert (number, n, oversized) == (k, len(p), far > 25000) and abs(extent - far) < 1e-6
