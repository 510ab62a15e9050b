import random
from datetime import datetime, timedelta

from sparwood.operators.orphans import orphans

T0 = datetime(2025, 1, 1)


def _brute(refs, parents):
    out = []
    for no, i, t in refs:
        if i is None:
            continue
        own = [p for p in parents if p[0] == i]
        if t is not None and any(a is not None and a <= t and (b is None or b > t) for _, a, b in own):
            continue
        first = min((a for _, a, _ in own if a is not None), default=None)
        reason = "missing" if not own else "late" if t is not None and first is not None and first > t else "deleted"
        out.append((no, reason))
    return sorted(out)


def test_orphans_equal_brute_force(spark):
    rng = random.Random(4)
    at = lambda: T0 + timedelta(hours=rng.randrange(24 * 200))
    parents = []
    for _ in range(150):
        i, a = rng.randrange(60), at()
        parents.append((i, rng.choice([a, a, a, None]), rng.choice([None, a + timedelta(hours=rng.randrange(2000))])))
    refs = [(k, rng.choice([rng.randrange(70), 7, None]), rng.choice([at(), at(), at(), None])) for k in range(600)]
    refs += [(9000, parents[0][0], parents[0][1]), (9001, parents[0][0], parents[0][2]), (9002, 7, T0.replace(day=1))]
    r = spark.createDataFrame([("t", "c", *x) for x in refs], "ref_table string, ref_column string, ref_no bigint, id bigint, t timestamp_ntz")
    p = spark.createDataFrame(parents, "id bigint, since timestamp_ntz, until timestamp_ntz")
    got = sorted((x.ref_no, x.reason) for x in orphans(r, p, ranges=4).collect())
    assert got == _brute(refs, parents)
    assert sorted(x.reason for x in orphans(r, p.where("id < 0"), ranges=4).collect()) == ["missing"] * sum(x[1] is not None for x in refs)
    assert orphans(r.where("id < 0"), p, ranges=4).count() == 0
