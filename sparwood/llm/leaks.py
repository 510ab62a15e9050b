"""Evaluation passages inside training texts, by an FM-index per training shard (problem 7).

Texts and items become sequences of words (single characters in scripts without spaces), without case, accents,
punctuation, markup and quote marks. A task packs its documents into shards of bounded size and builds an FM-index over
all words of each (:func:`index`). Shards know nothing of any items: written once, they can be searched for further ones
(:func:`search`), which takes all phrases of the items backwards through each index, locates the hits by sampled suffix
positions and merges hits of one item into spans. An exact check then aligns the words around the hits: single words may be changed,
dropped or added between runs of words that agree. A document leaks an item if one aligned passage has at least 20 words,
or 30 characters of unspaced scripts (a mix counts in proportion), on the item's side.

Items are the query set: executors turn them into blocks of bounded size (``ITEM_BYTES`` of prompts, or one longer prompt), which pass through the driver
one at a time and are sent to all tasks, so many (``AT_A_TIME``) to a pass over the shards. Nothing is shuffled, and no document, item, hit
or partner is dropped or capped.

Defined results: null and empty texts and prompts leak nothing; equal documents and equal items each come out; a text of
any length is indexed whole, alone in its shard if need be.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_stored, stored
from .fmindex import FMIndex

WORDS, CHARACTERS = 20, 30
#: Words per search phrase, symbols per shard, bytes of prompts per block, blocks per pass.
PHRASE, SHARD, ITEM_BYTES, AT_A_TIME = 4, 1 << 20, 1 << 20, 4
#: Words that must agree between two single-word differences.
BETWEEN = 2
#: Phrases of a passage that are found at least, whole or over a difference, and words from the start of one to the next at
#: most. Both follow from what _aligned accepts: runs of BETWEEN words at least, but for the last one, parted by two words at
#: most. A run leaves a phrase for each word beyond three, and one with the run after it. Runs of three leave fewest, four in
#: 20 words; the start of a phrase over a difference is five words before the next at most (2 + 2 + 1).
FEW, STEP = 4, 5
#: Words by which a passage can begin before its first phrase, and end behind the start of its last one, with some to spare: one
#: word of a first run of three; six words of the phrase, a difference of two and a last word.
BEFORE, BEHIND = 3, 12

_UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿"
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]*)+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|\[/?(?:quote|b|i|u|url|img|code|size|color|list|\*)\b[^\]\n]*\]", re.I | re.S)
_BLOCK = re.compile(r"[<\[]/?(?:p|br|div|blockquote|li|ul|ol|tr|td|table|h\d|hr|quote|list|code)\b", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[A-Za-z]{2,8});", re.I)
_GLUE = "\x00"
_INSIDE = "­​‌‍⁠﻿̀-ͯ\x00"
_WORD = re.compile(rf"[{_UNSPACED}][{_INSIDE}]*|(?:(?![{_UNSPACED}])[^\W_])(?:(?![{_UNSPACED}])[^\W_]|[{_INSIDE}])*")


@lru_cache(1 << 17)
def _folded(word: str) -> str:
    word = unicodedata.normalize("NFKD", re.sub(r"[­​-‍⁠﻿\x00]", "", word))
    return unicodedata.normalize("NFKC", "".join(c for c in word if not unicodedata.combining(c))).casefold()


def _masked(text: str) -> str:
    """Markup, entities and quote marks blanked out, all positions kept; an inline tag doesn't part a word."""
    if ">" in text:
        text = _QUOTE.sub(lambda m: " " * len(m.group()), text)
    if "<" in text or "[" in text:
        text = _TAG.sub(lambda m: (" " if _BLOCK.match(m.group()) else _GLUE) * len(m.group()), text)
    if "&" in text:

        def entity(m: re.Match) -> str:
            c = html.unescape(m.group())
            return c + _GLUE * (len(m.group()) - 1) if len(c) == 1 and c.isalnum() else " " * len(m.group())

        text = _ENTITY.sub(entity, text)
    return text


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Folded words of a text and their positions in it."""
    out, spans = [], []
    for m in _WORD.finditer(_masked(text)):
        if w := _folded(m.group()):
            out.append(w), spans.append(m.span())
    return out, spans


_IS_UNSPACED = re.compile(rf"[{_UNSPACED}]")


class Items:
    """A block of items: their words as symbols, and all phrases with the items and places that have them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.symbol: dict[str, int] = {}
        self.ids, self.seqs, self.weights = [], [], []
        for item, prompt in rows:
            w = words(prompt)[0]
            self.ids.append(item)
            self.seqs.append(np.array([self.symbol.setdefault(x, len(self.symbol) + 3) for x in w], np.int64))
            self.weights.append(np.array([1 / CHARACTERS if _IS_UNSPACED.match(x) else 1 / WORDS for x in w]))
        lengths = np.array([len(s) for s in self.seqs], np.int64)
        flat = np.concatenate(self.seqs) if self.seqs else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(self.seqs)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = np.flatnonzero(place + PHRASE <= lengths[item])
        self.item, self.place = item[first].astype(np.int32), place[first].astype(np.int32)
        self.phrases, which = np.unique(flat[first[:, None] + np.arange(PHRASE)].astype(np.int32), axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.order = np.argsort(which, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(which[self.order], np.arange(len(self.phrases) + 1))
        self._parted()

    def _parted(self) -> None:
        """Phrases with up to two words between their halves: pairs of words, and which pairs follow each other."""
        self.base = len(self.symbol) + 3
        pairs = [s[:-1] * self.base + s[1:] for s in self.seqs]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        parts = [np.empty((0, 4), np.int64)]
        for i, c in enumerate(pairs):
            c = np.searchsorted(self.pairs, c)
            for gap in range(3):
                if (n := len(c) - 2 - gap) > 0:
                    parts.append(np.stack([c[:n] * len(self.pairs) + c[2 + gap :], np.full(n, i), np.arange(n), np.full(n, gap)], 1))
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.parted = rows[:, 1:].astype(np.int32)
        self.keys, first = np.unique(rows[:, 0], return_index=True)
        self.key_starts = np.r_[first, len(rows)]

    def parted_in(self, text: np.ndarray) -> list[np.ndarray]:
        """For 0, 1 and 2 words between the halves in the text: the number of the key at each position, -1 without one."""
        none = np.full(len(text), -1, np.int64)
        if len(text) < PHRASE or not len(self.keys):
            return [none] * 3
        code = text[:-1] * self.base + text[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = (self.pairs[at] == code) & (text[:-1] > 2) & (text[1:] > 2)
        out = []
        for gap in range(3):
            key = none.copy()
            both = np.flatnonzero(known[: len(code) - 2 - gap] & known[2 + gap :]) if len(code) > 2 + gap else np.empty(0, np.int64)
            want = at[both] * len(self.pairs) + at[both + 2 + gap]
            k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            key[both] = np.where(self.keys[k] == want, k, -1)
            out.append(key)
        return out

    def parted_hits(self, key: np.ndarray, position: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in it and position of each key's phrases; those whole on both sides come from the index."""
        count = self.key_starts[key + 1] - self.key_starts[key]
        g = np.repeat(self.key_starts[key] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        position = np.repeat(position, count)
        if not gap:
            keep = self.parted[g, 2] > 0
            g, position = g[keep], position[keep]
        return self.parted[g, 0], self.parted[g, 1], position

    def occurrences(self, phrase: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of phrases spread over the items that have them: item, place in it, position."""
        count = self.starts[phrase + 1] - self.starts[phrase]
        at = np.repeat(self.starts[phrase] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        g = self.order[at]
        return self.item[g], self.place[g], np.repeat(position, count)


# How an aligned passage may go on from one agreeing word to the next (document, item): single differences
# (changed, added, dropped), and two that fall together, which are allowed between spaced words only.
_ONE = ((2, 2), (2, 1), (1, 2))
_TWO = ((3, 3), (3, 2), (2, 3), (3, 1), (1, 3))


class Places:
    """What the alignment needs of an item: the places of each word, the weight before each place, whether it is unspaced."""

    def __init__(self, item: np.ndarray, weight: np.ndarray):
        self.of: dict[int, list[int]] = {}
        for i, w in enumerate(item.tolist()):
            self.of.setdefault(w, []).append(i)
        self.before = np.concatenate([[0.0], np.cumsum(weight)]).tolist()
        self.unspaced = (weight < 1 / WORDS - 1e-9).tolist()


def _aligned(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, hits: np.ndarray, places: Places | None = None) -> list[tuple[int, int, float]]:
    """Passages (first and last document word, weight on the item's side) around hits (position, place) of one item.

    A cell (position, place) of equal words follows the cell before it on the diagonal, or one past a difference if
    BETWEEN words agreed since the last difference; of several, that of the longest passage. Two differences may fall
    together once in a passage: texts made from templates agree over long stretches but for whole phrases.
    """
    lo, hi = max(0, int(hits[:, 0].min()) - BEFORE), min(len(doc), int(hits[:, 0].max()) + BEHIND)
    first, last = int(hits[:, 1].min()) - BEFORE, int(hits[:, 1].max()) + BEHIND
    near = {int(d) + k for d in np.unique(hits[:, 0] - hits[:, 1]) for k in range(-4, 5)}
    places = places or Places(item, weight)
    of, by_place, unspaced = places.of, places.before, places.unspaced
    # Words since the last difference, start in document and item; the third key says whether two differences fell together.
    cells: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    out: dict[tuple[int, int], tuple[int, int, float]] = {}
    for j, w in enumerate(doc[lo:hi].tolist(), lo):
        for i in of.get(w, ()):
            if not first <= i <= last or j - i not in near:
                continue
            for twice in (0, 1):
                p = cells.get((j - 1, i - 1, twice))
                best = (p[0] + 1, p[1], p[2]) if p else None if twice else (1, j, i)
                ways = [(d, twice) for d in _ONE] + [(d, 0) for d in _TWO if twice and not unspaced[i]]
                for (dj, di), had in ways:
                    p = cells.get((j - dj, i - di, had))
                    if p and p[0] >= BETWEEN and (best is None or p[2] < best[2]):
                        best = (1, p[1], p[2])
                if best:
                    cells[j, i, twice] = best
                    size = by_place[i + 1] - by_place[best[2]]
                    if size >= 1 - 1e-9 and size > out.get(best[1:], (0, 0, 0.0))[2]:
                        out[best[1:]] = (best[1], j, size)
    return list(out.values())


#: Words of a shard whose hits are spread over the items at once.
_AT_ONCE = 1 << 17


def _runs(group: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Numbers of the runs of sorted hits of one group whose positions are STEP apart at most."""
    return np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (position[1:] - position[:-1] > STEP)]) if len(group) else np.empty(0, np.int64)


def _dense(hits: np.ndarray) -> np.ndarray:
    """Hits (document, item, position, place) among which a passage can be, in order, each once, and their run in a last column.

    A passage is a path on which positions and places rise: it leaves FEW hits of different position and place, none more
    than STEP from the next.
    """
    hits = hits[np.lexsort((hits[:, 3], hits[:, 2], hits[:, 1], hits[:, 0]))]
    hits = hits[np.r_[True, (hits[1:] != hits[:-1]).any(1)][: len(hits)]]
    run = _runs(hits[:, 0] << 32 | hits[:, 1], hits[:, 2])
    good = np.ones(len(hits), bool)
    for c in (2, 3):
        order = np.lexsort((hits[:, c], run))
        r, v = run[order], hits[order, c]
        new = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])][: len(r)]
        good &= np.bincount(r, new, minlength=1)[run] >= FEW
    return np.column_stack([hits, run])[good]


def _long_enough(hits: np.ndarray, ends: np.ndarray, items: Items) -> Iterator[tuple[int, int]]:
    """Runs of hits (bounds in ``ends``) around which an item has words enough for a passage.

    A passage begins at its first hit or a word before it, and goes on behind the start of its last one for at most that hit's
    six words, a difference of two and a last word.
    """
    if len(ends) < 2:
        return
    low, high = np.minimum.reduceat(hits[:, 3], ends[:-1]), np.maximum.reduceat(hits[:, 3], ends[:-1])
    for u, v, a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), low.tolist(), high.tolist()):
        if items.weights[hits[u, 1]][max(0, a - 1) : b + 9].sum() >= 1 - 1e-9:
            yield u, v


class Shard:
    """Documents as symbols (1 parts them, 2 is no word) with their words by symbol, and the FM-index over them."""

    def __init__(self, docs: list[np.ndarray], names: list[str]):
        self.names = names
        self.starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]).astype(np.int64)
        self.text = np.full(int(self.starts[-1]), 1, np.int32)
        for d, s in zip(docs, self.starts):
            self.text[s : s + len(d)] = d
        self.index = FMIndex(self.text)


def _search(docs: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(document, item, passages) of documents whose symbols are the items'."""
    return search_shard(Shard(docs, list(items.symbol)), items)


def search_shard(shard: Shard, items: Items) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(document, item, passages) of one shard."""
    starts = shard.starts
    # The shard's symbols in the items' terms (2: a word of no item) and back (0, which no text has: a word not in the shard).
    known = np.array([0, 1, 2, *(items.symbol.get(w, 2) for w in shard.names)], np.int64)
    back = np.zeros(items.base, np.int64)
    back[known[3:]] = np.arange(3, len(known))
    back[2] = 0
    text = known[shard.text]
    docs = [text[a : b - 1] for a, b in zip(starts[:-1], starts[1:])]
    phrases = back[items.phrases]
    there = np.flatnonzero((phrases > 0).all(1))
    whole = [(there[phrase], position) for phrase, position in shard.index.find(phrases[there])]
    keys = items.parted_in(text)
    # Positions of any phrase first: where too few are near each other, no item has a passage.
    some = np.zeros(len(text), bool)
    for _, position in whole:
        some[position] = True
    for key in keys:
        some |= key >= 0
    where = np.flatnonzero(some)
    run = _runs(np.searchsorted(starts, where, side="right"), where)
    some[where] = np.bincount(run, minlength=1)[run] >= FEW
    cuts = sorted({0, *np.searchsorted(starts, np.arange(_AT_ONCE, len(text), _AT_ONCE)).tolist(), len(docs)})
    known_places = lru_cache(None)(lambda item: Places(items.seqs[item], items.weights[item]))
    found: dict[tuple[int, int], list] = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = int(starts[a]), int(starts[b])
        parts = []
        for phrase, position in whole:
            in_ = (position >= lo) & (position < hi) & some[position]
            parts.append(items.occurrences(phrase[in_], position[in_]))
        for gap, key in enumerate(keys):
            position = lo + np.flatnonzero(some[lo:hi] & (key[lo:hi] >= 0))
            parts.append(items.parted_hits(key[position], position, gap))
        item, place, position = (np.concatenate(c) for c in zip(*parts))
        doc = np.searchsorted(starts, position, side="right") - 1
        hits = _dense(np.stack([doc, item, position - starts[doc], place], 1))
        ends = np.flatnonzero(np.r_[True, hits[1:, 4] != hits[:-1, 4], True])[: len(hits) + 1]
        for u, v in _long_enough(hits, ends, items):
            doc, item = int(hits[u, 0]), int(hits[u, 1])
            if passages := _aligned(docs[doc], items.seqs[item], items.weights[item], hits[u:v, 2:4], known_places(item)):
                found.setdefault((doc, item), []).extend(passages)
    for (doc, item), passages in found.items():
        yield doc, item, passages


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus as shards: keys (those of the documents, in order), shard (documents, words, places and FM-index, pickled).

    Documents with too few words for a phrase are left out, as nothing can be found in them.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol: dict[str, int] = {}
        keys, docs, places, size, key_type = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            blob = pickle.dumps((Shard(docs, list(symbol)), places), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(key_type)), pa.array([blob], pa.binary())], ["keys", "shard"])

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, at = words(t) if t else ([], [])
                if len(w) < PHRASE:
                    continue
                if docs and size + len(w) > SHARD:
                    yield flush()
                    symbol = {}
                    keys, docs, places, size = [], [], [], 0
                keys.append(k)
                docs.append(np.fromiter((symbol.setdefault(x, len(symbol) + 3) for x in w), np.int32, len(w)))
                places.append(np.array(at, np.int32))
                size += len(w) + 1
        if docs:
            yield flush()

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"keys array<{kind}>, shard binary")


def search(shards: DataFrame, items: DataFrame, item_key: str, prompt: str, key: str, spans: bool = False) -> DataFrame:
    """key, item_id, and with spans start_pos, end_pos: what of the items the documents of an :func:`index` hold."""
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    schema = f"`{key}` {kind}, item_id bigint" + (", start_pos int, end_pos int" if spans else "")

    def one(blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key_type = b.schema.field(0).type.value_type
                for row in range(b.num_rows):
                    keys, (shard, places) = b.column(0)[row].values, pickle.loads(b.column(1)[row].as_py())
                    for block in blocks:
                        items = pickle.loads(block.value)
                        found = [(doc, items.ids[item], p) for doc, item, passages in search_shard(shard, items) for p in (_merged(passages) if spans else [None])]
                        columns = [keys.take(pa.array([f[0] for f in found], pa.int64())).cast(key_type), pa.array([f[1] for f in found], pa.int64())]
                        if spans:
                            columns += [pa.array([int(places[d][p[k]][k]) for d, _, p in found], pa.int32()) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays(columns, [key, "item_id", "start_pos", "end_pos"][: len(columns)])

        return shards.mapInArrow(run, schema)

    blocks = _blocks(items, item_key, prompt)
    return reduce(DataFrame.unionAll, [one(blocks[k : k + AT_A_TIME]) for k in range(0, max(1, len(blocks)), AT_A_TIME)])


def _merged(found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b, _ in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, key: str, prompt: str) -> list[Broadcast]:
    """The items as pickled blocks of bounded size, sent to the executors. Null and empty prompts and keys are left out."""
    spark = items.sparkSession
    i = items.select(F.col(key).cast("long"), prompt).where(F.col(prompt).isNotNull() & (F.length(prompt) > 0) & F.col(key).isNotNull())
    n = int((i.agg(F.sum(F.octet_length(prompt))).first()[0] or 0) // ITEM_BYTES) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        full = lambda: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Items(rows), protocol=5)], pa.binary())], ["block"])
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows and size + len(t.encode()) > ITEM_BYTES:
                    yield full()
                    rows, size = [], 0
                rows.append((k, t))
                size += len(t.encode())
        if rows:
            yield full()

    packed = stored(i.repartition(n).mapInArrow(pack, "block binary"), "item_blocks")
    out = [spark.sparkContext.broadcast(bytes(r.block)) for r in packed.toLocalIterator()]
    drop_stored(packed)
    return out


def _shards(df: DataFrame, key: str, text: str, items: DataFrame, prompt: str) -> DataFrame:
    """The corpus as shards; written, if there will be more than one pass over them."""
    shards = index(df, key, text)
    size = items.agg(F.sum(F.octet_length(prompt))).first()[0] or 0
    return stored(shards, "shards") if size > AT_A_TIME * ITEM_BYTES // 2 else shards


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, prompt: str) -> DataFrame:
    """key, item_id: every document with every item of which it holds a passage."""
    return search(_shards(df, key, text, items, prompt), items, item_key, prompt, key)


def removal_spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, prompt: str) -> DataFrame:
    """key, start_pos, end_pos, n_items: what to cut from each document, overlapping passages of all items merged."""
    s = search(_shards(df, key, text, items, prompt), items, item_key, prompt, key, spans=True)
    by = Window.partitionBy(key).orderBy("start_pos", "end_pos", "item_id")
    reach = F.max("end_pos").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce((F.col("start_pos") > reach).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(by))
    merged = s.groupBy(key, "part").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.countDistinct("item_id").alias("n_items"))
    return merged.drop("part")


def _tables(spark: SparkSession, folder: str) -> tuple:
    return spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{folder}/heldout_items.parquet"), "item_id", "prompt"


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id of every leak."""
    return leaks(*_tables(spark, folder))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start_pos, end_pos (code points, end excluded), n_items: the spans to remove."""
    return removal_spans(*_tables(spark, folder))
