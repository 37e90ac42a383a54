"""Suffix order of a block of contexts, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


class Block:
    """Contexts joined, each ended by a mark of its own; marks sort first, by position.

    ``order`` is the suffix array, ``levels`` the ranks by the first 1, 2, 4, ... units.
    """

    def __init__(self, parts: list[np.ndarray]):
        lengths = np.array([len(p) for p in parts], np.int64)
        _, units = np.unique(np.concatenate(parts), return_inverse=True)
        self.ends = np.cumsum(lengths + 1) - 1  # of the marks
        self.starts = self.ends - lengths
        n = int(self.ends[-1]) + 1
        self.units = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        self.units[inside] = units + 1
        self.left = (np.repeat(self.ends, lengths + 1) - np.arange(n)).astype(np.int32)  # units up to the mark
        self.levels = [self.units.astype(np.int32)]
        rank, have, longest = self.units, 1, int(lengths.max()) + 1
        self.order = _sorted(rank, n)[0]
        while have < longest:
            follow = np.zeros(n, np.int64)
            follow[: n - have] = np.where(self.left[: n - have] >= have, rank[have:], 0)
            self.order, key = _sorted(rank * (int(rank.max()) + 1) + follow, n)
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            have *= 2
            self.levels.append(rank.astype(np.int32))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, within their contexts."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step, rank = 1 << k, self.levels[k]
            p, q = i + length, j + length
            same = (self.left[p] >= step) & (self.left[q] >= step) & (rank[p] == rank[q])
            length += step * same
        return length


def _sorted(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of rising keys, ties by place, and the keys; as plain numbers where both fit in 63 bits, which sorts fastest."""
    bits = n.bit_length()
    if int(key.max()).bit_length() + bits <= 63:
        packed = np.sort((key << bits) | np.arange(n))
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]
