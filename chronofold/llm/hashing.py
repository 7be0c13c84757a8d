"""Vectorised word and n-gram hashes over UTF-8 bytes.

A word's hash is a polynomial in the ring of integers modulo 2**64 over a random value of each
byte, taken from one running sum over a block of whole words: the difference of two sums times the
inverse power of the word's start. It depends on the word alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1342543DE82EF95)
#: Bytes hashed with one table of powers, and the longest table that is kept.
BLOCK, KEPT = 1 << 18, 1 << 20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(seed: int = 1) -> np.ndarray:
    """A value for each byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=U) + U(seed * 0x632BE59BD9B4E019 % (1 << 64)))
    values[65:91] = values[97:123]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below ``n``; tables beyond KEPT are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for b in (_BASE, _INVERSE):
        steps = np.full(max(n, BLOCK + 1), U(b))
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


class Words:
    """The words of some texts: starts, ends (byte positions), hashes, and each text's word range."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, values: np.ndarray):
        inside = is_word[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2], edge[1::2]  # every text ends with a line feed, which is in no word
        self.first = np.searchsorted(self.starts, bounds)
        self.hashes = np.empty(len(self.starts), U)
        lo = 0
        while lo < len(self.starts):  # in blocks of whole words, so that a long text needs no long table
            begin = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, begin + BLOCK, side="right")))
            stop = int(self.ends[hi - 1])
            up, down = powers(stop - begin + 1)
            sums = np.zeros(stop - begin + 1, U)
            np.cumsum(values[data[begin:stop]] * up[:-1], out=sums[1:])
            starts, ends = self.starts[lo:hi] - begin, self.ends[lo:hi] - begin
            raw = (sums[ends] - sums[starts]) * down[starts]
            self.hashes[lo:hi] = mix(raw ^ (ends - starts).astype(U) * _STEP)
            lo = hi

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes; the caller leaves out those across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total = total * _STEP + hashes[j : j + n]
    return mix(total + U(k))


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k``-grams within single texts begin, for texts' word ranges ``first``."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    skipped = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + skipped


def table_of(ranges: str, invert: bool = False) -> np.ndarray:
    """Which bytes match: ``ranges`` has pairs of first and last byte in hex, such as ``30-39 61-7a``."""
    found = np.zeros(256, bool)
    for pair in ranges.split():
        lo, hi = (int(x, 16) for x in pair.split("-"))
        found[lo : hi + 1] = True
    return ~found if invert else found
