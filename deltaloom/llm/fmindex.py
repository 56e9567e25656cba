"""A compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet tree, searched backwards.

The tree is kept by levels (a wavelet matrix): level by level, from the highest bit of the symbols, one packed bit for each
position, with the number of ones before every block of 64. A symbol's rank takes one look per level, so all operations work
on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np


#: The bits in front of each of 64 positions.
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        blocks = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
        blocks[: len(packed)] = packed
        self.blocks = blocks.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.blocks[block] & _LOW[i & 63])

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.rows, self.zeros = [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level) & 1
            self.rows.append(Bits(bits.astype(bool)))
            self.zeros.append(int(len(now) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in front of position i, offset by where the symbol's run starts in the last level."""
        for level, (bits, zeros) in enumerate(zip(self.rows, self.zeros)):
            ones = bits.ones(i)
            i = np.where(symbol & (1 << (self.levels - 1 - level)), zeros + ones, i - ones)
        return i

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and their ranks there."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.rows, self.zeros):
            one, ones = bits.at(i), bits.ones(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols at least, by doubling; positions after the end count lowest."""
    rank, k, n = text.astype(np.int64), 1, len(text)
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, k = new, k * 2
        if k >= depth or rank.max() == n - 1:
            return order


class FmIndex:
    """Index of a text of symbols 1 .. alphabet - 1, where 0 separates sequences and ends the text.

    ``weights``: how often what stands at each position occurs, if sequences stand for several equal ones; then the size of
    an interval of suffixes is the sum of their weights.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int, weights: np.ndarray | None = None):
        if not len(text) or text[-1] != 0:
            text = np.append(text, 0)
            weights = None if weights is None else np.append(weights, 1)
        order = suffix_order(text, depth + 1)
        self.n, self.text, self.order = len(text), text, order
        self.sums = None if weights is None else np.concatenate([[0], np.cumsum(weights[order])])
        self.tree = WaveletTree(text[order - 1], alphabet)  # the transform: what stands before each suffix, cyclically
        counts = np.bincount(text, minlength=alphabet)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.base = self.tree.rank(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with the symbol and go on like those in [low, high)."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return shift + both[: len(symbol)], shift + both[len(symbol) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low if self.sums is None else self.sums[high] - self.sums[low]

    def matching_lengths(self, text: np.ndarray, ends: np.ndarray, most: int, least_count: int = 2) -> np.ndarray:
        """For each end (exclusive) in ``text``: how far back, ``most`` at most, what stands before it occurs at least
        ``least_count`` times in the index."""
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(most):
            at = ends[live] - 1 - k
            inside = at >= 0
            live, low, high, at = live[inside], low[inside], high[inside], at[inside]
            symbol = text[at]
            inside = symbol > 0
            live, low, high, symbol = live[inside], low[inside], high[inside], symbol[inside]
            if not len(live):
                break
            low, high = self.step(symbol, low, high)
            enough = self.occurrences(low, high) >= least_count
            live, low, high = live[enough], low[enough], high[enough]
            length[live] = k + 1
            # an interval of one suffix is a place in the indexed text: from there on the texts are compared
            lone = high - low == 1
            if lone.any():
                self._extend(text, ends[live[lone]], most, self.order[low[lone]], live[lone], length)
                live, low, high = live[~lone], low[~lone], high[~lone]
        return length

    def _extend(self, text: np.ndarray, ends: np.ndarray, most: int, place: np.ndarray, owner: np.ndarray, length: np.ndarray) -> None:
        """Lengthen matches that have only one place left, for as long as what stands in front of both is equal."""
        at, left = ends - length[owner], most - length[owner]
        while len(owner):
            at, place, left = at - 1, place - 1, left - 1
            inside = (at >= 0) & (place >= 0) & (left >= 0)
            at, place, left, owner = at[inside], place[inside], left[inside], owner[inside]
            same = (text[at] == self.text[place]) & (text[at] > 0)
            at, place, left, owner = at[same], place[same], left[same], owner[same]
            length[owner] += 1


def full_suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of a text that ends in 0 in the order of their suffixes, each up to its first 0; equal ones by position.

    Ranks of several places are packed into one number, so a round multiplies the depth; positions with a place of their own
    take no part in later rounds.
    """
    n, ends = len(text), text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()) - 1)
    order, slots, depth = np.arange(n), np.arange(n), 1
    grouped = False
    while len(slots):
        bits = max(1, int(rank.max()).bit_length())
        many = max(2, 63 // bits)
        who = order[slots]
        key = np.zeros(len(who), np.int64)
        for k in range(many):
            at = who + k * depth
            key = key << bits | np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        sort = np.argsort(key)
        order[slots], key = who[sort], key[sort]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        rank = rank.copy() if grouped else np.empty(n, np.int64)
        rank[order[slots]] = slots[np.repeat(first, np.diff(np.append(first, len(slots))))]
        grouped = True
        shared = ~(new & np.append(new[1:], True))
        slots, depth = slots[shared], depth * many
    return order


class SampledIndex:
    """FM-index of a text of symbols 1 .. alphabet - 1 in stretches that end in 0: counts and locates patterns.

    What is kept is the wavelet tree of the transform and the places of every ``rate``-th position and of each stretch's first
    one; other places are found by going back in the text, ``rate`` steps at most.
    """

    def __init__(self, text: np.ndarray, alphabet: int, rate: int = 16):
        order = full_suffix_order(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.first = np.cumsum(counts) - counts
        self.shift = self.first - self.tree.rank(np.arange(alphabet), np.zeros(alphabet, np.int64))
        sampled = (order % rate == 0) | (text[order - 1] == 0)
        self.marks, self.places = Bits(sampled), order[sampled].astype(np.int32)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of the suffixes that start with each pattern, a row of which the first symbols count."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        live = np.arange(len(lengths))
        for k in range(int(lengths.max(initial=0))):
            live = live[(low[live] < high[live])]
            now = live[lengths[live] > k]
            symbol = patterns[now, lengths[now] - 1 - k].astype(np.int64)
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[now], high[now]]))
            low[now], high[now] = self.shift[symbol] + both[: len(now)], self.shift[symbol] + both[len(now) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            known = self.marks.at(rows)
            out[live[known]] = self.places[self.marks.ones(rows[known])] + steps
            live, rows, steps = live[~known], rows[~known], steps + 1
            symbol, rank = self.tree.at(rows)
            rows = self.shift[symbol] + rank
        return out
