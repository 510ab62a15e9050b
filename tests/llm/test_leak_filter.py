"""The search before the alignment loses nothing that the alignment accepts."""

import random

import numpy as np
import pytest

pytest.importorskip("sparwood.llm")
from sparwood.llm import leaks as L  # noqa: E402


def _placings(n, first, last):
    yield ()
    for k in range(first, last + 1):
        for rest in _placings(n, k + 3, last):
            yield (k, *rest)


@pytest.mark.parametrize("words", [[f"w{k}" for k in range(20)], [chr(0x4E00 + k) for k in range(30)]], ids=["words", "characters"])
def test_all_placings_of_single_changes(words):
    n = len(words)
    items = L.Items([(1, " ".join(words))])
    assert len(items.seqs[0]) == n
    docs = []
    for changed in _placings(n, 2, n - 2):
        d = items.seqs[0].copy()
        d[list(changed)] = 2
        docs.append(d)
    assert {doc for doc, _, _ in L._search(docs, items)} == set(range(len(docs)))


def test_random_differences_equal_the_alignment_of_all_words():
    rng = random.Random(11)
    prompt = [f"w{rng.randrange(60)}" for _ in range(45)]
    items = L.Items([(1, " ".join(prompt))])
    item = items.seqs[0].tolist()
    docs = []
    for _ in range(1500):
        out, k = [2] * rng.randrange(4), rng.randrange(22)
        while k < len(item) and len(out) < 30:
            run = rng.choice([1, 2, 2, 2, 3, 3, 4])
            out += item[k : k + run]
            k += run + rng.choice([0, 1, 1, 1, 1, 2])
            out += [rng.choice([2, *item])] * rng.choice([0, 1, 1, 1, 2])
        docs.append(np.array(out, np.int64))
    want = set()
    for n, d in enumerate(docs):
        cells = np.array([(j, i) for j, w in enumerate(d.tolist()) for i, v in enumerate(item) if v == w]).reshape(-1, 2)
        if len(cells) and L._aligned(d, items.seqs[0], items.weights[0], cells):
            want.add(n)
    got = {n for n, _, _ in L._search(docs, items)}
    assert got == want and 50 < len(want) < len(docs) - 50
