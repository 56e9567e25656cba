"""Hashed words and shingles as arrays; hashes are the same in every process.

Words are found and hashed in the bytes of an Arrow column, without a Python object for any of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit function of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ U(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) + _A
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


_VALUE = mixed(np.arange(256, dtype=U), 21)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(size, U(b))]), dtype=U) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last one ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def gaps(characters: str) -> np.ndarray:
    """Which bytes are one of the ASCII ``characters``."""
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out


def words_of(data: np.ndarray, at: np.ndarray, gap: np.ndarray = _SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all words of texts whose bytes are ``data``, cut at ``at``. ``gap``: which bytes aren't in words."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    up, down = POWERS(len(data) + 1)
    value = _VALUE[_LOWER] if lower else _VALUE
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(value[data] * up[: len(data)], out=sums[1:])
        h = mixed((sums[ends] - sums[starts]) * down[starts] + mixed((ends - starts).astype(U), 22))
    return h, starts, ends


def word_hashes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and how many words each text has. ``lower``: A-Z count as a-z."""
    data, at = text_bytes(column)
    h, starts, _ = words_of(data, at, lower=lower)
    return h, np.diff(np.searchsorted(starts, at))


class Numbers:
    """Places of hashes in a list of distinct ones, found in a table of slots; the few that share a slot by bisection."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted, self.hashes = hashes[self.order], hashes
        self.mask = U((1 << max(4, (4 * len(hashes)).bit_length())) - 1)
        slot = (hashes & self.mask).astype(np.int64)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.slots[slot] = np.arange(len(hashes), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=len(self.slots)) > 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't in the list."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        slot = (h & self.mask).astype(np.int64)
        place = self.slots[slot].astype(np.int64)
        wrong = self.hashes[place] != h
        wrong |= place < 0
        rest = np.flatnonzero(wrong & self.shared[slot])
        place[wrong] = -1
        at = np.minimum(np.searchsorted(self.sorted, h[rest]), len(self.sorted) - 1)
        place[rest] = np.where(self.sorted[at] == h[rest], self.order[at], -1)
        return place


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, U(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _B + words[i : i + n]
            out ^= out >> U(29)
    return mixed(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct runs of ``k`` words, sorted; with fewer words, the whole sequence is one."""
    return np.unique(grams(words, min(k, len(words)))) if len(words) else np.empty(0, U)


def by_text(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
