"""An FM-index over a sequence of integer symbols, in numpy: suffix array, wavelet matrix, sampled positions.

All searches are vectorised over phrases: a backward-search step moves the suffix ranges of all phrases by one symbol,
with two ranks each in the wavelet matrix. Bits are packed, with a count before every word of 64, so that an index takes
a bit and a half per symbol and bit of the alphabet, and can be written and read again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; s must end in a unique smallest symbol."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length()) if n else 1
    k = max(1, min(63 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(k):  # as many symbols as fit into one number come first
        key <<= bits
        key[: n - j] |= s[j:]
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = np.flatnonzero(~new | np.r_[~new[1:], False])
    while len(tied):
        # Only suffixes that still tie are sorted again, by what stands k symbols on; the last symbol being unique, none runs out.
        part = order[tied]
        both = rank[part] * (n + 1) + rank[np.minimum(part + k, n - 1)]
        by = np.argsort(both, kind="stable")
        part, both = part[by], both[by]
        order[tied] = part
        new = np.r_[True, both[1:] != both[:-1]]
        rank[part] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | np.r_[~new[1:], False]]
        k *= 2
    return order


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank of any symbol in any prefix in one step per bit of the alphabet."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            b = (s >> level) & 1 == 1
            self.ones.append(Bits(b))
            self.zeros.append(int(len(s) - b.sum()))
            s = np.concatenate([s[~b], s[b]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position end[i]."""
        lo, hi = np.zeros_like(end), end
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            one = (symbol >> level) & 1 == 1
            a, b = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank before it."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones.get(hi)
            a, b = ones.rank(lo), ones.rank(hi)
            symbol = symbol * 2 + one
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


class FMIndex:
    """Finds where phrases occur in s (symbols from 1; a 0 is put at the end)."""

    def __init__(self, s: np.ndarray, sample: int = 16):
        s = np.concatenate([s.astype(np.int64), [0]])
        order = suffix_array(s)
        self.n = len(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))]).astype(np.int64)
        self.matrix = WaveletMatrix(s[order - 1])
        marked = order % sample == 0
        self.marks = Bits(marked)
        self.samples = order[marked].astype(np.int32 if self.n < 1 << 31 else np.int64)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of a two-dimensional array of phrases of one length."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        known = len(self.before) - 1
        for j in range(width - 1, -1, -1):
            c = phrases[live, j]
            inside = c < known
            lo[live[~inside]] = hi[live[~inside]] = 0
            live, c = live[inside], c[inside]
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled position, all rows at once."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            hit = self.marks.get(at)
            out[live[hit]] = (self.samples[self.marks.rank(at[hit])] + steps) % self.n
            live, at = live[~hit], at[~hit]
            if len(live):
                symbol, rank = self.matrix.access(at)
                at = self.before[symbol] + rank
            steps += 1
        return out

    def find(self, phrases: np.ndarray, rows_at_once: int = 1 << 20):
        """Yields (phrase numbers, positions) of all occurrences, in parts of bounded size."""
        lo, hi = self.ranges(phrases)
        found = np.flatnonzero(hi > lo)
        ends = np.cumsum(hi[found] - lo[found])
        i = 0
        while i < len(found):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + rows_at_once, side="right")))
            part = found[i:j]
            count = hi[part] - lo[part]
            which = np.repeat(part, count)
            rows = np.repeat(lo[part] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            yield which, self.locate(rows)
            i = j
