"""A compressed FM-index of word sequences in numpy, built and searched for one shard.

Suffixes are sorted by their first ``depth`` words only.  For intervals of up
to that depth the backward step is exact all the same: the suffixes that begin
with a word c and a class of depth - 1 words are those before which c stands in
the class's interval.  The last column is a wavelet tree (as a matrix: one
bit-packed level per bit of the alphabet, with counts every 64 bits).
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class WaveletTree:
    """Rank of any symbol in a sequence of symbols, for many places at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(symbols)
        now = symbols.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            part = np.packbits(ones, bitorder="little")
            packed[: len(part)] = part
            words = packed.view(_U)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])
        #: where each symbol's run starts below the last level
        self.start = np.zeros(size, np.int64)
        self.start = self._fall(np.arange(size), np.zeros(size, np.int64))

    def _fall(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            block = place >> 6
            below = self.words[i][block] & ((_U(1) << (place & 63).astype(_U)) - _U(1))
            ones = self.counts[i][block] + np.bitwise_count(below)
            place = np.where(symbol >> level & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._fall(symbol, place) - self.start[symbol]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of the keys among their distinct values."""
    order = np.argsort(keys, kind="stable")
    steps = np.empty(len(keys), bool)
    steps[:1], steps[1:] = True, keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(steps)
    return out


def _later(ranks: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(ranks)
    out[: max(0, len(ranks) - by)] = ranks[by:]
    return out


class FMIndex:
    """Index of sequences of word hashes, each ended by a mark; every sequence has ``depth`` words or more."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, depth: int):
        self.depth, self.sizes = depth, sizes
        names, code = np.unique(words, return_inverse=True)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.text = np.zeros(len(words) + len(sizes), np.int32)
        gone = np.zeros(len(self.text), bool)
        gone[self.begin + sizes] = True
        self.text[~gone] = code + 1
        n, half = len(self.text), 1
        ranks = self.text.astype(np.int64)
        while half * 2 <= depth - 1:
            ranks = _dense(ranks * (n + 1) + _later(ranks, half))
            half *= 2
        whole = ranks * (n + 1) + _later(ranks, depth - half)
        self.order = np.argsort(whole, kind="stable")
        less = (ranks * (n + 1) + _later(ranks, depth - 1 - half))[self.order]
        whole = whole[self.order]
        self.classes = self._starts(whole)
        shorter = self._starts(less)
        # of each place: the interval of suffixes that agree in depth - 1 words
        which = np.searchsorted(shorter, np.arange(n), "right") - 1
        self.low, self.high = shorter[which].astype(np.int32), np.append(shorter[1:], n)[which].astype(np.int32)
        self.tree = WaveletTree(self.text[self.order - 1], len(names) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(names) + 1))])

    @staticmethod
    def _starts(keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the symbol before what stands at the intervals."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]

    def least(self, value: np.ndarray) -> np.ndarray:
        """Per class of equal ``depth`` words, the least value of the sequences it occurs in."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        return np.minimum.reduceat(value[owner[self.order]], self.classes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stream every sequence from its end and report each run of ``depth`` words.

        Returns sequence, start within it, and class.  All sequences advance
        together; after the first ``depth`` steps each step drops the last word
        (by widening to the interval of depth - 1 words) and takes one more.
        """
        by_size = np.argsort(-self.sizes, kind="stable")
        ends, sizes = (self.begin + self.sizes)[by_size], self.sizes[by_size]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.text), np.int64)
        out = [], [], []
        for taken in range(1, int(sizes.max(initial=0)) + 1):
            active = int(np.searchsorted(-sizes, -taken, "right"))
            low, high = low[:active], high[:active]
            if taken > self.depth:
                low, high = self.low[low], self.high[low]
            low, high = self.step(self.text[ends[:active] - taken], low, high)
            if taken >= self.depth:
                out[0].append(by_size[:active])
                out[1].append(sizes[:active] - taken)
                out[2].append(np.searchsorted(self.classes, low, "right") - 1)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
