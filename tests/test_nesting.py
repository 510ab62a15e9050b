import json
import random

from sparwood.operators import nesting as N


def _brute(text):
    """Numbers by plain recursion."""
    v = N.parse(text)
    out = []

    def lists(o):
        if isinstance(o, list):
            return [x for y in o for x in lists(y)]
        if not isinstance(o, dict):
            return []
        if "elemendid" in o:
            return [N.objects(o["elemendid"])]
        return [x for y in o.values() for x in lists(y)]

    found = lists(v)
    elements = [x for y in found for x in y] if found else N.objects(v)
    for i, e in enumerate(elements, 1):
        out.append((i, 0, 0))
        for j, m in enumerate(N.objects(e.get("mootmised")), 1):
            out.append((i, j, 0))
            out += [(i, j, k) for k, _ in enumerate(N.objects(m.get("kahjustused")), 1)]
    return sorted(out)


def _random(rng, depth=0):
    if depth == 3:
        return rng.choice([{"kood": "A", "aste": "2,5"}, {}, None, 3])
    kids = [_random(rng, depth + 1) for _ in range(rng.randrange(4))]
    kids = rng.choice([kids, kids, kids, None, kids[0] if kids else {}])
    o = {["", "mootmised", "kahjustused"][depth]: kids} if depth else {}
    return o | {"korgus": rng.choice([1, "7.5", None])}


def test_numbers_equal_plain_recursion(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        e = [_random(rng, 1) for _ in range(rng.randrange(4))]
        shape = rng.choice([e, {"elemendid": e}, {"rinded": [{"elemendid": e}, {"elemendid": e[:1]}, {"elemendid": None}]}, e[0] if e else {}])
        t = json.dumps(shape)
        texts.append(rng.choice([t, t, t, json.dumps(t), t[:-2]]))
    texts += [None, "", "  ", "null", "[]", "{}", "3", '"x"', "[NaN]", "[[{}]]", '{"elemendid": []}', "[" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "fid bigint, composition string")
    got = {}
    for r in N.numbers(df, "fid", "composition").collect():
        got.setdefault(r.fid, []).append((r.element_no, r.measurement_no, r.damage_no))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == _brute(t), t


def test_tables_keep_links_and_types(spark):
    text = json.dumps({"rinded": [{"rinne_kood": "A", "elemendid": [{"puuliik_kood": "MA", "osakaal": "21,0", "vanus": "x", "enamus": "true", "mootmised": {"aasta": 2020, "kahjustused": [None, {"kood": "P", "aste": "2"}]}}]}]})
    df = spark.createDataFrame([(1, text, "clash"), (1, text, "again")], "fid bigint, composition string, osakaal string")
    e = N.flat_table(df, "fid", "composition", 1).collect()
    assert len(e) == 2 and (e[0].rinne_kood, e[0].puuliik_kood, e[0].osakaal, e[0].vanus, e[0].enamus) == ("A", "MA", 21.0, None, True)
    d = N.flat_table(df, "fid", "composition", 3).first()
    assert (d.fid, d.element_no, d.measurement_no, d.damage_no, d.kood, d.aste) == (1, 1, 1, 1, "P", 2.0)
    levels = {r.path: (r.reps, r.defs) for r in N.level_columns(df.limit(1), "fid", "composition").collect()}
    assert levels["element.measurement.damage.kood"] == ([0], [4]) and levels["element.vanus"] == ([0], [2]) and levels["element.korgus"] == ([0], [1])
    assert N.numbers(df.where("fid < 0"), "fid", "composition").count() == 0
