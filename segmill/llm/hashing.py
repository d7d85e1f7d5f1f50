"""64-bit hashes of many runs of bytes at once, and look-ups of many keys at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(12345)
#: A random number for each byte, and powers of an odd number (and of its inverse) modulo 2**64, for hashes of runs of bytes.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 3


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def run_hashes(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[a:b] for each pair; equal bytes give equal hashes."""
    n = len(codes) + 1
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        _POWERS[:] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_BYTE[codes] * _POWERS[0][: n - 1], out=sums[1:])
    h = (sums[b] - sums[a]) * _POWERS[1][a]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """From distinct unsigned keys to their numbers in the given list; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        home = self._home(keys)
        order = np.lexsort((keys, home))
        self.keys, self.numbers = keys[order], order.astype(np.int32)
        self.first = np.searchsorted(home[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.keys = np.append(self.keys, keys.dtype.type(0))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        at, end = self.first[home], self.first[home + 1]
        hit = (self.keys[at] == keys) & (at < end)
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit[left] = self.keys[at[left]] == keys[left]
            left = left[~hit[left] & (at[left] + 1 < end[left])]
        out = np.full(len(keys), -1, np.int32)
        out[hit] = self.numbers[at[hit]]
        return out
