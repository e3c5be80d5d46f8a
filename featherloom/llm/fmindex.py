"""An FM-index over integer symbols: suffix sorting, wavelet-tree ranks, sampled locations.

All steps work on numpy arrays. Symbols are small non-negative integers; 0 is reserved
for the end of the text and may not occur in it.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes of ``text`` in order; its last symbol is a unique smallest 0.

    The first sort compares as many symbols as fit into 63 bits; each later round doubles
    the depth, over those suffixes only that still tie.
    """
    n, deep = len(text), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(deep):
        key <<= bits
        if k < n:
            key[: n - k] |= text[k:]
    sa = np.argsort(key)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    while True:
        first = np.flatnonzero(new)
        head = np.repeat(first, np.diff(np.append(first, n)))
        rank[sa] = head
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        # suffixes that tie at this depth are long enough to have a symbol beyond it
        pair = head[at] * n + rank[np.minimum(sa[at] + deep, n - 1)]
        order = np.argsort(pair)
        sa[at], pair = sa[at][order], pair[order]
        new[at] = np.r_[True, pair[1:] != pair[:-1]]
        deep *= 2


class BitVector:
    """Bits with constant-time ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks and access for a sequence, a level per bit of its symbols, most significant first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append(BitVector(bit))
            one = bit.astype(bool)
            left = symbols[~one]
            self.zeros.append(len(left))
            symbols = np.concatenate((left, symbols[one]))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence leads at the leaf of ``symbol``."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def leaf(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and where those positions lead."""
        symbol = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.at(i).astype(np.int64), level.rank(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i


class FMIndex:
    """Counts and locates patterns in a text of symbols 1 .. 2**bits - 1."""

    def __init__(self, text: np.ndarray, bits: int, every: int = 32):
        whole = np.append(text.astype(np.int64), 0)
        sa = suffix_array(whole, bits)
        last = whole[sa - 1]
        self.n, self.every = len(whole), every
        self.tree = WaveletTree(last, bits)
        counts = np.bincount(last, minlength=1 << bits)
        symbols = np.arange(1 << bits)
        # from a leaf position to the row of the suffix that is one symbol longer
        self.shift = np.cumsum(counts) - counts - self.tree.descend(symbols, np.zeros_like(symbols))
        sampled = sa % every == 0
        self.marked, self.places = BitVector(sampled), sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern; ``patterns`` is right-aligned in its rows."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for step in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - step]
            lo[live] = self.tree.descend(c, lo[live]) + self.shift[c]
            hi[live] = self.tree.descend(c, hi[live]) + self.shift[c]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at ``rows``: walk back to the next sampled one."""
        found, todo, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked.at(row).astype(bool)
            found[todo[hit]] = self.places[self.marked.rank(row[hit])] + steps
            todo, row = todo[~hit], row[~hit]
            c, leaf = self.tree.leaf(row)
            row, steps = leaf + self.shift[c], steps + 1
        return found
