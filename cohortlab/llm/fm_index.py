"""A compressed full-text index over word sequences: suffix order, BWT, wavelet matrix with bit ranks, backward search.

``FMIndex`` holds the segments of one shard.  ``matched`` computes matching statistics of every segment against the segments of
*earlier* documents and reports the intervals that reach a threshold; all segments move on together, one backward step at a time.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """A packed bit vector with ranks: number of ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros((n >> 6) + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for level in reversed(range(max(1, int(top).bit_length()))):
            bits = (values >> level & 1).astype(bool)
            self.levels.append((level, BitRanks(bits)))
            values = np.concatenate([values[~bits], values[bits]])
        # where the first copy of each symbol would stand after the last level
        self.first = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a symbol stands before a position."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (a suffix that is a beginning of another comes first)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else sorted_key
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if not n or new[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    def __init__(self, segments: list[list[str]], documents: np.ndarray):
        """``documents[i]``: number of the first document that holds segment i."""
        m = len(segments)
        sizes = np.array([len(s) for s in segments], np.int64)
        names: dict[str, int] = {}
        flat = np.array([names.setdefault(w, len(names)) for s in segments for w in s], np.int64)
        self.start = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + m
        is_end = np.zeros(n, bool)
        is_end[self.start + sizes] = True
        self.text = np.zeros(n, np.int64)  # 0: end of a segment, words from 1 on
        self.text[~is_end] = flat + 1
        unique = self.text + m  # ends sort first and differ, so that no comparison runs over an end
        unique[is_end] = np.arange(m)
        self.sizes, self.n, self.top = sizes, n, len(names)
        order = suffix_order(unique)
        bwt = self.text[order - 1]  # of the first suffix: the last end, cyclic
        self.wavelet = WaveletMatrix(bwt, self.top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.top + 1))])
        owner = np.repeat(np.arange(m), sizes + 1)
        self.documents = np.unique(documents, return_inverse=True)[1].astype(np.int32)
        self.lowest = [self.documents[owner[order]]]  # sparse table: smallest document in each run of 2^k suffixes
        while 2 << len(self.lowest) - 1 <= n:
            half = 1 << len(self.lowest) - 1
            self.lowest.append(np.minimum(self.lowest[-1][:-half], self.lowest[-1][half:]))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffix interval of symbol + pattern from that of the pattern."""
        both = self.wavelet.occurrences(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.below[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def first_document(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document of the suffixes in non-empty intervals."""
        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int32)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            table = self.lowest[level]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << int(level))])
        return out

    def matched(self, least: int) -> list[list[tuple[int, int]]]:
        """Per segment the intervals [a, b) of at least ``least`` words that occur in a segment of an earlier document.

        A run starts at a right end e and goes left while an earlier document has the words.  Stopped at i, no window that holds
        both i and e can match, and those right of i are inside the run; so the next run starts at
        min(e - 1, i + least - 1).
        """
        found: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        who = np.flatnonzero(self.sizes >= least)
        end = self.start[who] + self.sizes[who] - 1
        at, lo, hi = end + 1, np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        while len(who):
            a, b = self.step(self.text[at - 1], lo, hi)
            ok = b > a
            ok[ok] = self.first_document(a[ok], b[ok]) < self.documents[who[ok]]
            at = np.where(ok, at - 1, at)
            lo, hi = np.where(ok, a, lo), np.where(ok, b, hi)
            begin = self.start[who]
            over = ~ok | (at == begin)
            for j in np.flatnonzero(over & (end - at + 1 >= least)):
                found[who[j]].append((int(at[j] - begin[j]), int(end[j] + 1 - begin[j])))
            again = ~ok
            end = np.where(again, np.minimum(end - 1, at + least - 2), end)
            at = np.where(again, end + 1, at)
            lo, hi = np.where(again, 0, lo), np.where(again, self.n, hi)
            stay = np.where(again, end - begin + 1 >= least, at > begin)
            who, end, at, lo, hi = who[stay], end[stay], at[stay], lo[stay], hi[stay]
        return found
