import random

import numpy as np
import pytest

pytest.importorskip("sparwood.llm")
from sparwood.llm import leaks as L  # noqa: E402
from sparwood.llm.fmindex import FMIndex, suffix_array  # noqa: E402


@pytest.mark.parametrize("n", [1, 2, 50, 2000])
def test_index_finds_all_occurrences(n):
    rng = np.random.default_rng(n)
    s = np.concatenate([rng.integers(1, 5, n), np.full(30, 2), rng.integers(1, 5, n)])
    order = suffix_array(np.r_[s, 0])
    assert [tuple(np.r_[s, 0][i:]) for i in order] == sorted(tuple(np.r_[s, 0][i:]) for i in order)
    phrases = np.unique(rng.integers(1, 7, (100, 3)), axis=0)
    got = set()
    for which, at in FMIndex(s, sample=7).find(phrases, rows_at_once=10):
        got |= set(zip(which.tolist(), at.tolist()))
    assert got == {(k, i) for k in range(len(phrases)) for i in range(len(s) - 2) if (s[i : i + 3] == phrases[k]).all()}


WORDS = [f"{a}{b}" for a in ("stone", "river", "lamp", "cloud", "field", "crow", "mill") for b in ("er", "ing", "ed", "us", "ly", "ish")]


def test_passages_with_noise_and_limits(spark):
    rng = random.Random(5)
    prompts = {k: [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)] for k in range(4)}
    far = lambda n: " ".join(rng.choice("abcdefgh") * 3 for _ in range(n))
    p = prompts[0]
    noisy = p[5:35]
    noisy[7], noisy[20] = "changed", noisy[20] + " added"
    del noisy[13]
    unspaced = "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(80))
    docs = {
        1: far(30) + " " + " ".join(p[:20]) + " " + far(9), 2: " ".join(p[:19]), 3: "> " + "\n> ".join(" ".join(noisy[i : i + 4]) for i in range(0, 30, 4)),
        4: " ".join(w.upper() + "," for w in prompts[1][10:40]), 5: "<p>" + " ".join(f"<b>{w}</b>" if i % 3 == 0 else w for i, w in enumerate(prompts[2][:25])) + "</p>",
        6: unspaced[10:40], 7: unspaced[10:39], 8: None, 9: "", 10: far(5000), 11: " ".join(p[:12]) + " " + far(3) + " " + " ".join(p[12:24]), 12: "、".join(unspaced[40:75]),
    }
    items = {100: " ".join(prompts[0]), 101: " ".join(prompts[1]), 102: " ".join(prompts[2]), 103: unspaced, 104: None, 105: "", 106: " ".join(prompts[0])}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(list(items.items()), "item_id bigint, prompt string")
    got = {tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "prompt").collect()}
    assert got == {(1, 100), (1, 106), (3, 100), (3, 106), (4, 101), (5, 102), (6, 103), (12, 103)}
    spans = {r.doc_id: (r.start_pos, r.end_pos, r.n_items) for r in L.removal_spans(d, "doc_id", "text", i, "item_id", "prompt").collect()}
    a, b, n = spans[1]
    assert docs[1][a:b] == " ".join(p[:20]) and n == 2
    assert L.leaks(d.where("doc_id < 0"), "doc_id", "text", i, "item_id", "prompt").count() == 0
    assert L.leaks(d, "doc_id", "text", i.where("item_id < 0"), "item_id", "prompt").count() == 0


def test_shards_and_item_blocks_give_the_same(spark, monkeypatch):
    d, i = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/heldout_items.parquet")
    whole = {tuple(r) for r in L.leaks(d, "doc_id", "text", i, "item_id", "prompt").collect()}
    docs = d.select("doc_id", "text").collect()
    items = [L.Items([(r.item_id, r.prompt)]) for r in i.collect() if r.prompt]
    one_by_one = set()
    words = {r.doc_id: L.words(r.text or "")[0] for r in docs}
    for it in items:
        for k, w in words.items():
            s = np.array([it.symbol.get(x, 2) for x in w], np.int64)
            if len(s) >= L.PHRASE:
                one_by_one |= {(k, it.ids[0]) for _ in L._search([s], it)}
    assert whole == one_by_one
