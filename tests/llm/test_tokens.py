import base64
import random

import pytest

pytest.importorskip("sparwood.llm")
tiktoken = pytest.importorskip("tiktoken")
from sparwood.llm import tokens as T  # noqa: E402

TEXTS = ["", " ", "Hello  world\n\n\n x", "it's I'll they've DON'T", "<|endoftext|> a", "日本語のテキスト。ไทย हिन्दी العربية", "a" * 3000, " " * 500 + "x", "naïve é̈ ½ №7 ﬁ 👩‍🌾", "\r\n\t\x00​﻿", "x=1;y=2.50e-3//##"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.vocabulary_path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_equal_the_library(spark, reference):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab'lsdt 1\n.é日 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = [*docs, *TEXTS, *odd, None]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in T.encoded(df, "doc_id", "text").collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert T.encoded(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_appends_and_edits_are_exact(reference):
    rng = random.Random(4)
    v = T.vocabulary(T.vocabulary_path())
    base = " ".join(TEXTS) + "".join(rng.choice("ab'lsdt 1\n.é日 ") for _ in range(300))
    for _ in range(150):
        text = base[(i := rng.randrange(len(base))) : i + rng.randrange(200)]
        cut = rng.randrange(len(text) + 1)
        e = T.Encoded(v, text[:cut])
        e.append(text[cut:])
        assert e.ids() == reference(text)
        for _ in range(4):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 3, 30]))
            by = rng.choice(["", " ", "  ", "\n\n", "s", "'", "x1", "日本", "'ll "])
            e.replace(a, b, by)
            text = text[:a] + by + text[b:]
            assert e.ids() == reference(text) and e.text == text
