"""Components of dense graphs and linkage by a grid: reduced early, and equal to the plain ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparwood.operators import components, partition


def test_a_task_sends_a_forest(spark):
    n = 600
    pairs = spark.range(n).select(F.col("id").alias("u")).join(spark.range(n).select(F.col("id").alias("v")), F.expr("u > v AND u % 3 = v % 3"))
    e = components.forest(pairs.coalesce(2))
    assert e.count() <= 2 * (n - 3)
    got = components.components(spark.range(n + 2), pairs.union(spark.createDataFrame([(n + 1, n + 7), (5, n + 7), (n, n)], "u bigint, v bigint")), a="u", b="v")
    assert {(r.id, r.root) for r in got.collect()} == {(i, i % 3 if i < n else i) for i in range(n + 2)}


@pytest.mark.parametrize("grid", [True, False])
def test_linkage_equals_all_pairs(grid):
    rng = np.random.default_rng(2)
    for n in (2, 40, 150):
        p = rng.integers(0, 7, (n, 2)) * 1000.0 if grid else rng.random((n, 2)) * 60000
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        label = partition.complete_linkage(p, 3500.0 if grid else 15000.0)
        cap = 3500.0 if grid else 15000.0
        far = {(a, b): d[np.ix_(label == a, label == b)].max() for a in set(label.tolist()) for b in set(label.tolist())}
        assert all((v <= cap) == (a == b) for (a, b), v in far.items())
        if not grid:
            own = [{i} for i in range(n)]
            while len(own) > 1:
                v, a, b = min((d[np.ix_(list(x), list(y))].max(), i, j) for j, y in enumerate(own) for i, x in enumerate(own[:j]))
                if v > cap:
                    break
                own[a] |= own.pop(b)
            assert {frozenset(s) for s in own} == {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}
