"""64-bit hashes and tables of them on arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """64-bit keys to numbers, by open addressing on arrays; key 0 stands for an empty slot."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.values = bits, np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int64)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their numbers."""
        at = self._at(h)
        there = self.keys[at]
        hit = there == h
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            good = there == h[todo]
            hit[todo[good]] = True
            todo = todo[~good & (there != 0)]
        return hit, self.values[at]

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        at = self._at(h)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]  # of several for a slot one stays
            mine = free[self.keys[at[free]] == h[free]]
            self.values[at[mine]] = values[mine]
            todo = todo[self.keys[at[todo]] != h[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
