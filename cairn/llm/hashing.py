"""Runs of bytes hashed all at once with numpy, and a table of such hashes."""

from __future__ import annotations

import numpy as np

_BASE, _OTHER = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_INVERSE_OTHER = pow(_OTHER, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the two bases and of their inverses, kept for the longest block met."""

    def __init__(self):
        self.size = 0

    def of(self, n: int):
        if n > self.size:
            self.size = max(1 << 16, n + n // 4)
            self.tables = [_powers(b, self.size) for b in (_BASE, _INVERSE, _OTHER, _INVERSE_OTHER)]
        return self.tables


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def run_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, how_many: int = 2) -> list[np.ndarray]:
    """One or two 64-bit polynomial hashes (mixed) of each run ``x[start:end]``."""
    up, down, up2, down2 = POWERS.of(len(x) + 1)
    digits = x.astype(np.uint64) + np.uint64(1)
    out = []
    for u, d in ((up, down), (up2, down2))[:how_many]:
        sums = np.empty(len(x) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(digits * u[: len(x)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * d[starts]))
    return out


class HashTable:
    """Open addressing from (key, check) to numbers given in order of insertion."""

    def __init__(self, bits: int = 16):
        self._make(bits)
        self.n = 0

    def _make(self, bits):
        self.bits = bits
        self.key, self.check, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers, or -1."""
        mask = np.int64((1 << self.bits) - 1)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        check = check.astype(np.uint32)
        out = self.value[slot]
        open_ = np.nonzero((out >= 0) & ((self.key[slot] != key) | (self.check[slot] != check)))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            s = slot[open_]
            out[open_] = self.value[s]
            open_ = open_[(self.value[s] >= 0) & ((self.key[s] != key[open_]) | (self.check[s] != check[open_]))]
        return out

    def add(self, key: np.ndarray, check: np.ndarray):
        """Insert distinct keys that are not in the table; they get the next numbers."""
        while 2 * (self.n + len(key)) > 1 << self.bits:
            used = np.nonzero(self.value >= 0)[0]
            old = self.key[used], self.check[used], self.value[used]
            self._make(self.bits + 1)
            self._put(*old)
        self._put(key, check.astype(np.uint32), np.arange(self.n, self.n + len(key), dtype=np.int32))
        self.n += len(key)

    def _put(self, key, check, value):
        mask = np.int64((1 << self.bits) - 1)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(key):
            free = np.nonzero(self.value[slot] < 0)[0]
            self.value[slot[free]] = value[free]
            won = np.zeros(len(key), bool)
            won[free] = self.value[slot[free]] == value[free]
            self.key[slot[won]], self.check[slot[won]] = key[won], check[won]
            rest = ~won
            key, check, value, slot = key[rest], check[rest], value[rest], (slot[rest] + 1) & mask
