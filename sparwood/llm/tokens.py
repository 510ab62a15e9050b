"""Token ids of whole texts by prefix dynamic programming over a public byte-level BPE vocabulary (problem 6).

Byte-pair encoding has a property that this rests on: every prefix of a piece has one encoding, and whether a token may
follow another one depends on these two alone. So per byte prefix the one valid last token is stored; a token that ends
at a position is valid if it may follow the last token of the prefix before it. Candidates come from an Aho-Corasick
automaton over the vocabulary. The tokens of any prefix are read off backwards. Appending goes on from the stored state;
an edit re-encodes from the piece before it until the old pieces are met again.

Pieces come from the vocabulary's own splitting pattern, over the whole text. Pieces repeat, so a task keeps a bounded
cache of their ids. Results equal those of the tokenizer libraries, which the tests hold it against. Null and empty
texts give an empty list; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.json"
CACHED_PIECES = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary: /opt/tokenizers, or that of the installed package of vocabularies."""
    for folder in ("/opt/tokenizers", os.path.dirname(getattr(importlib.util.find_spec("public_tokenizers"), "origin", None) or "")):
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(name)


def _printable_bytes() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by id: token bytes, the two halves of each token, and the automaton that finds tokens in bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = _printable_bytes()
        ids = model["vocab"]
        self.bytes_of = {i: bytes(map(stand_in.__getitem__, t)) for t, i in ids.items() if all(c in stand_in for c in t)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.merged[pair], self.halves[whole] = whole, pair
        self.tokens = {b: i for i, b in self.bytes_of.items() if len(b) == 1 or i in self.halves}
        self.length = {i: len(b) for b, i in self.tokens.items()}
        self.longest = max(self.length.values())
        self.automaton = ahocorasick.Automaton()
        for b, i in self.tokens.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).finditer
        self.follows = lru_cache(1 << 20)(self._follows)
        self.encode_piece = lru_cache(CACHED_PIECES)(self._encode_piece)

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: undo merges on both sides of the border, latest first; no merge across the
        border may have come before one that was undone."""
        limit = 1 << 60
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                if a not in self.halves:
                    return True
                limit, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    if a not in self.halves:
                        return True
                    limit, a = a, self.halves[a][1]
                    continue
                limit, b = b + 1, self.halves[b][0]

    def extend(self, text: str, last: list[int]) -> None:
        """Carry the last tokens of prefixes on to all of text (bytes as Latin-1); last has those known so far."""
        done = len(last)
        last.extend([-1] * (len(text) - done))
        begin = max(0, done - self.longest + 1)
        follows, length = self.follows, self.length
        for end, token in self.automaton.iter(text, begin):
            if end < done or last[end] >= 0:
                continue
            before = end - length[token]
            if before < 0 or follows(last[before], token):
                last[end] = token

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.tokens.get(data)
        if token is not None:
            return (token,)
        last: list[int] = []
        self.extend(data.decode("latin-1"), last)
        return self.read(last)

    def read(self, last: list[int]) -> tuple[int, ...]:
        out, at = [], len(last) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.length[last[at]]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pieces(text):
            piece = m.group()
            out += self.encode_piece(piece) if len(piece) <= 64 else self._encode_piece(piece)
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoded:
    """An encoded text that can be appended to and edited; ids() is always what encoding the whole text would give."""

    def __init__(self, v: Vocabulary, text: str = ""):
        self.v, self.text = v, ""
        self.cuts: list[int] = []  # starts of pieces
        self.last: list[list[int]] = []  # last tokens by piece
        self.append(text)

    def _piece(self, text: str, known: list[int] | None = None) -> list[int]:
        last = known or []
        self.v.extend(text.encode("utf-8", "surrogatepass").decode("latin-1"), last)
        return last

    def append(self, more: str) -> None:
        """The last piece may grow, which extends its stored prefixes; earlier pieces stay as they are."""
        if not more:
            return
        start = self.cuts[-1] if self.cuts else 0
        old = self.text[start:]
        state = self.last.pop() if self.last else []
        if self.cuts:
            self.cuts.pop()
        self.text += more
        for m in self.v.pieces(self.text, start):
            grown = m.start() == start and m.group().startswith(old)
            self.cuts.append(m.start()), self.last.append(self._piece(m.group(), state if grown else None))

    def replace(self, begin: int, end: int, by: str) -> None:
        """Replace text[begin:end]: pieces before the edit and those met again after it are kept.

        A run of white space is split by what follows it, so that up to three pieces before the edit may change.
        """
        from bisect import bisect_left, bisect_right

        shift = len(by) - (end - begin)
        first = max(0, bisect_right(self.cuts, begin) - 3)
        start = self.cuts[first] if self.cuts else 0
        old = dict(zip((c + shift for c in self.cuts), range(len(self.cuts))))
        self.text = self.text[:begin] + by + self.text[end:]
        safe = begin + len(by) + 1
        cuts, last = self.cuts[:first], self.last[:first]
        tail = bisect_left(self.cuts, end)
        for m in self.v.pieces(self.text, start):
            if m.start() >= safe and (k := old.get(m.start(), -1)) >= tail:
                cuts += [c + shift for c in self.cuts[k:]]
                last += self.last[k:]
                break
            cuts.append(m.start()), last.append(self._piece(m.group()))
        self.cuts, self.last = cuts, last

    def ids(self) -> list[int]:
        return [t for last in self.last for t in self.v.read(last)]


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key, ids: array<int> of every row, in one pass without shuffle; rows of equal key each come out."""
    path = path or vocabulary_path()
    # The file goes to the executors with the job, as they may not have it in the same place.
    df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(os.path.basename(path)))
        for b in batches:
            ids = pa.array([v.encode(t) if t else [] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encoded(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, tokens and characters by source and language, as a check on the mix of a corpus."""
    d = spark.read.parquet(f"{folder}/documents.parquet")
    of = encoded(d.select(F.struct("source", "lang", F.length("text").alias("n")).alias("doc"), "text"), "doc", "text")
    return of.groupBy("doc.source", "doc.lang").agg(F.count("*").alias("docs"), F.sum(F.size("ids")).cast("long").alias("tokens"), F.sum("doc.n").cast("long").alias("chars"))
