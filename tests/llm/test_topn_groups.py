import random

import pytest

pytest.importorskip("sparwood.llm")
from sparwood.llm import groups, topn  # noqa: E402


def _rows(rng, n):
    return [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 0.5, 0.5, rng.random()]), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("held,fan_in,waiting", [(500_000, 512, 1 << 16), (10, 512, 1), (500_000, 1, 1), (500_000, 512, 1)])
def test_top_n_equals_brute_force(spark, monkeypatch, held, fan_in, waiting):
    monkeypatch.setattr(topn, "WAITING_ROWS", waiting)
    monkeypatch.setattr(topn, "HELD_ROWS", held)
    monkeypatch.setattr(topn, "FAN_IN", fan_in)
    rows = _rows(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "id bigint, g int, h string, s double, t int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = {(r.id, r.place) for r in topn.top_n(df, ["g", "h"], "s", ["t", "id"], 7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key in {(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None}:
        own = [r for r in rows if (r[1], r[2]) == key and r[3] is not None and r[3] == r[3]]
        own.sort(key=lambda r: (-r[3], r[4] is None, r[4] or 0, r[0]))
        want |= {(r[0], i) for i, r in enumerate(own[:7], 1)}
    assert got == want
    assert topn.top_n(df.where("id < 0"), ["g", "h"], "s", ["t", "id"], 7).count() == 0


def test_repeated_rows_count_each(spark):
    df = spark.createDataFrame([(1, 0.5, 9)] * 3, "g int, s double, id bigint")
    assert sorted(r.place for r in topn.top_n(df, ["g"], "s", ["id"], 2).collect()) == [1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    pairs += [(k, k + 1) if k % 2 else (k + 1, k) for k in range(1000, 1200)]  # a long chain
    pairs += [(5000, k) for k in range(4000, 4300)]  # a hub
    pairs += [(7, 7), (7777, 7777), (None, 3), (8888, None), (None, None)] + pairs[:20]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*p, 1) for p in pairs], "id_a bigint, id_b bigint, id int")
    got = groups.groups(df, "id_a", "id_b").collect()
    assert {r.id: r.group_id for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert groups.groups(df.where("id_a < 0"), "id_a", "id_b").count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    n = 4096
    mixed = list(range(n))
    random.Random(3).shuffle(mixed)
    chains = {
        "ascending": [(k, k + 1) for k in range(n - 1)], "descending": [(k + 1, k) for k in reversed(range(n - 1))],
        "shuffled": list(zip(mixed, mixed[1:])), "hub": [(10**6, k) for k in range(n)],
    }
    for name, pairs in chains.items():
        got = groups.groups(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b")
        assert groups.LAST["rounds"] + groups.LAST["jumps"] <= 24, (name, groups.LAST)
        assert got.select("group_id").distinct().collect() == [(0,)], name
