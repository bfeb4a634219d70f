"""A compressed FM-index over integer sequences: the BWT as a wavelet tree of packed bits with rank directories.

Suffixes are sorted by their first ``depth`` symbols only, which is all that patterns up to that length can tell apart.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence: one packed bit vector a level (levels laid out one after another, zeros first)."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, np.uint8)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(int(self.n - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place; ``at`` may have leading axes more than ``symbol``."""
        first, at = np.zeros_like(symbol), at.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbol >> level & 1).astype(bool)
            both = np.concatenate([first[None], at.reshape(-1, len(symbol))])
            word = both >> 6
            ranks = self.ones[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            both = np.where(one, self.zeros[i] + ranks, both - ranks)
            first, at = both[0], both[1:].reshape(at.shape)
        return at - first


class FMIndex:
    """The index of ``text`` (symbols from 1; 0 separates), for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        ranks = {1: np.unique(text, return_inverse=True)[1].astype(np.int64)}

        def pair(a: int, b: int, shift: int) -> np.ndarray:
            """Ranks by a symbols and then by b symbols from ``shift`` on."""
            late = np.full(n, -1, np.int64)
            late[: n - shift] = ranks[b][shift:]
            return np.unique(ranks[a] * (n + 1) + late + 1, return_inverse=True)[1].astype(np.int64)

        size = 1
        while 2 * size <= depth:
            ranks[2 * size] = pair(size, size, size)
            size *= 2
        full = pair(size, size, depth - size) if depth > size else ranks[size]
        less = pair(size, size, depth - 1 - size) if depth - 1 > size else ranks[size] if depth - 1 == size else pair(size // 2, size // 2, depth - 1 - size // 2)
        self.suffixes = np.argsort(full, kind="stable")
        bwt = text[self.suffixes - 1]
        bwt[self.suffixes == 0] = 0
        self.tree = WaveletTree(bwt)
        self.before = np.searchsorted(np.sort(text), np.arange(int(text.max(initial=0)) + 2))
        in_order = less[self.suffixes]
        new = np.append(True, in_order[1:] != in_order[:-1])
        edges = np.append(np.flatnonzero(new), n)
        self.group = np.cumsum(new) - 1
        self.edges = edges

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with one more symbol in front; empty ones for unknown symbols."""
        known = symbol < len(self.before) - 1
        symbol, high = np.where(known, symbol, 0), np.where(known, high, low)
        at = self.before[symbol] + self.tree.rank(symbol, np.stack([low, high]))
        return at[0], at[1]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns without their last symbol, for patterns of full depth."""
        group = self.group[low]
        return self.edges[group], self.edges[group + 1]


def _search(index: FMIndex, text: np.ndarray, t: int, columns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of the patterns of these lengths that start in row t of the columns of ``text``."""
    low, high = np.zeros(len(columns), np.int64), np.full(len(columns), len(index.suffixes), np.int64)
    for back in range(int(lengths.max(initial=0)), 0, -1):
        on = np.flatnonzero((lengths >= back) & (low < high))
        low[on], high[on] = index.extend(text[t + back - 1, columns[on]], low[on], high[on])
    return low, high


def matching_statistics(index: FMIndex, docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each document and each place, the interval and length (up to the index's depth) of the longest match that starts there.

    All documents stream at once, from their ends to their starts. A match of full depth loses its last symbol before it is
    extended; where the extension still fails, the longest shorter match is found by halving its possible lengths.
    """
    n, longest = len(docs), max(map(len, docs), default=0)
    text = np.zeros((longest, n), np.int64)
    for i, d in enumerate(docs):
        text[longest - len(d) :, i] = d
    size = len(index.suffixes)
    low, high, length = np.zeros(n, np.int64), np.full(n, size, np.int64), np.zeros(n, np.int64)
    lows, highs, lengths = (np.zeros((longest, n), np.int64) for _ in range(3))
    for t in range(longest - 1, -1, -1):
        live = np.flatnonzero(text[t])
        c = text[t, live]
        a, b, m = low[live], high[live], length[live]
        full = m == index.depth
        a[full], b[full] = index.shorten(a[full])
        m[full] -= 1
        x, y = index.extend(c, a, b)
        m += 1
        fails = np.flatnonzero(x >= y)
        if len(fails):
            least, most = np.zeros(len(fails), np.int64), m[fails] - 1  # lengths: that occurs, that may
            while (least < most).any():
                half = (least + most + 1) // 2
                u, v = _search(index, text, t, live[fails], half)
                least, most = np.where(u < v, half, least), np.where(u < v, most, half - 1)
            x[fails], y[fails] = _search(index, text, t, live[fails], least)
            m[fails] = least
        low[live], high[live], length[live] = x, y, m
        lows[t, live], highs[t, live], lengths[t, live] = low[live], high[live], length[live]
    return [(lows[longest - len(d) :, i], highs[longest - len(d) :, i], lengths[longest - len(d) :, i]) for i, d in enumerate(docs)]
