"""A full-text index over words: Burrows-Wheeler transform in a wavelet tree, searched backwards for many texts at a time."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, by doubling, and for each place in that order the number of its class of equal first `depth` symbols."""
    n = len(symbols)
    rank, k, by_length = symbols.astype(np.int64), 1, {}
    pad = lambda r, by: np.concatenate([r[by:] + 1, np.zeros(min(by, n), np.int64)])

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        out = np.empty(n, np.int64)
        out[order] = fresh
        return order, out

    order, rank = ranked(rank)
    while True:
        by_length[k] = rank
        if rank.max() == n - 1 or k >= n:
            break
        order, rank = ranked(rank * (n + 2) + pad(rank, k))
        k *= 2
    longest = max((x for x in by_length if x <= depth), default=1)
    classes = by_length[longest]
    if longest < depth and classes.max() < n - 1:  # two overlapping stretches make up the depth
        classes = ranked(classes * (n + 2) + pad(classes, depth - longest))[1]
    return order, classes[order]


class WaveletTree:
    """Ranks in a sequence: one row of packed bits for each bit of a symbol, in the layout that keeps zeros of a row before its ones."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.n, self.bits, self.rows = len(sequence), bits, []
        now = sequence.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            ones = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([ones, np.zeros(-len(ones) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            self.rows.append((packed, before, int(len(ones) - ones.sum())))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        symbols = np.arange(1 << bits)
        self.origin = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in enumerate(self.rows):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.origin[symbols]


class FMIndex:
    """Index of texts given as numbers from 1 on, joined with 0 between them; `depth` is the length that matches are cut to."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n, self.depth = len(symbols), depth
        order, classes = suffix_order(symbols, depth)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.tree = WaveletTree(symbols[order - 1], self.bits)
        counts = np.bincount(symbols, minlength=(1 << self.bits) + 1)
        self.first = np.cumsum(counts) - counts
        edges = np.flatnonzero(np.diff(classes)) + 1
        begin, end = np.concatenate([[0], edges]), np.concatenate([edges, [self.n]])
        which = np.repeat(np.arange(len(begin)), end - begin)
        self.begin, self.end = begin[which], end[which]

    def matches(self, texts: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each place of `texts`, how often the `depth` symbols from there occur in the index; 0 where they don't or the text ends.

        All texts are searched at once, each from its end. A search takes in one symbol to the left; at full depth the matches are
        widened to all that share the first `depth` symbols. Where nothing matches, no stretch over both the new symbol and the last
        one can match, so the search begins anew one symbol before the last. Symbols unknown to the index are negative.
        """
        found = np.zeros(len(texts), np.int64)
        lane = np.flatnonzero(lengths >= self.depth)
        base = starts[lane].astype(np.int64)
        last = base + lengths[lane]  # where the match ends
        at, lo, hi = last - 1, np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(base):
            c = texts[at]
            known = np.maximum(c, 0)
            both = self.tree.rank(np.concatenate([known, known]), np.concatenate([lo, hi])) + np.tile(self.first[known], 2)
            lo, hi = both[: len(base)], both[len(base) :]
            hit = (lo < hi) & (c >= 0)
            full = hit & (last - at >= self.depth)
            rows = lo[full]
            lo[full], hi[full] = self.begin[rows], self.end[rows]
            found[at[full]] = hi[full] - lo[full]
            last = np.where(full, at + self.depth, np.where(hit, last, last - 1))
            lo, hi = np.where(hit, lo, 0), np.where(hit, hi, self.n)
            at = np.where(hit, at, last) - 1
            if (go := (at >= base) & (last - base >= self.depth)).all():
                continue
            base, last, at, lo, hi = base[go], last[go], at[go], lo[go], hi[go]
        return found
