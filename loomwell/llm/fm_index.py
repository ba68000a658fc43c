"""An FM-index over a sequence of small integers: suffix array, wavelet-tree ranks, backward search.

All steps work on whole arrays: many phrases are searched, and many occurrences located, at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; only suffixes not yet told apart are sorted again.

    ``symbols`` ends with its only 0, so that no suffix is a prefix of another.
    """
    n = len(symbols)
    small = int(symbols.max()) < 1 << 16
    order = np.argsort(symbols.astype(np.uint16) if small else symbols, kind="stable")  # 16 bits: a radix sort
    rank = np.zeros(n, dtype=np.int64)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(symbols[order[1:]], symbols[order[:-1]], out=new[1:])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank[order] = heads
    width = 1
    while True:
        places = np.flatnonzero(~(new & np.append(new[1:], True)))  # groups of more than one
        if not len(places):
            return order
        suffixes = order[places]
        follow = suffixes + width
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        by = np.lexsort((after, rank[suffixes]))
        suffixes, after, group = suffixes[by], after[by], rank[suffixes[by]]
        order[places] = suffixes
        split = np.ones(len(places), dtype=bool)
        split[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[places] = split
        heads = np.maximum.accumulate(np.where(split, places, 0))
        rank[suffixes] = heads
        width *= 2


class WaveletTree:
    """Ranks over a sequence, one bit plane for each bit of the alphabet, most significant first.

    In each plane the symbols are stably parted by that bit, zeros first; ``ones[p]`` counts set bits before p.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        symbols = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each ``place``."""
        low = np.zeros_like(place)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return place - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each ``place``."""
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """``symbols``: positive integers; positions are theirs."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.sample = sample
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        marked = order % sample == 0
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.positions = order[marked]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of equal length (rows), the bounds of the suffixes that begin with each."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.before[-1], dtype=np.int64)
        for column in phrases.T[::-1]:
            known = column < len(self.before) - 1
            symbol = np.where(known, column, 0)
            base = self.before[symbol]
            low, high = base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)
            high = np.where(known, np.maximum(low, high), low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row of the suffix order: step back to a sampled row."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        for steps in range(self.sample):
            hit = self.marked[rows + 1] > self.marked[rows]
            out[todo[hit]] = self.positions[self.marked[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            if not len(todo):
                break
            symbol = self.tree.at(rows)
            rows = self.before[symbol] + self.tree.rank(symbol, rows)
        return out
