"""A fixed table from pairs of small numbers to numbers, looked up for whole arrays."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing with linear probing, at most a quarter full; a pair that is not held gives -1."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        keys, values = self._keys(np.asarray(left), np.asarray(right)), np.asarray(values, dtype=np.int64)
        bits = max(int(4 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[todo[placed]], values[todo[placed]]
            left_over = np.ones(len(todo), dtype=bool)
            left_over[placed] = False
            todo, at = todo[left_over], (at[left_over] + 1) & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair of numbers from 0 to 2^31 - 1."""
        keys = self._keys(left, right)
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at_todo = (at[todo] + 1) & self.mask
            at[todo] = at_todo
            held = self.keys[at_todo]
            same = held == keys[todo]
            out[todo[same]] = self.values[at_todo[same]]
            todo = todo[~same & (held >= 0)]
        return out
