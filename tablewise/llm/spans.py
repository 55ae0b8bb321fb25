"""Spans of bytes in numpy: exact comparison of many pairs, and a hash table of spans that compares before it merges."""

from __future__ import annotations

import numpy as np

_LONG = 4096        # longer pairs are compared one by one


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number each; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class Comparison:
    """Are the spans a[s:s + n] and b[t:t + n] equal, byte for byte? For many pairs of two buffers."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None):
        self.a = a
        self.b = a if b is None else b
        self.eights_a = _eights(a)
        self.eights_b = self.eights_a if b is None else _eights(b)

    def equal(self, start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
        n = end_a - start_a
        same = n == end_b - start_b
        for i in np.flatnonzero(same & (n > _LONG)):
            same[i] = np.array_equal(self.a[start_a[i]:end_a[i]], self.b[start_b[i]:end_b[i]])
        left = np.flatnonzero(same & (n > 0) & (n <= _LONG))
        at = 0
        while len(left):
            differ = self.eights_a[start_a[left] + at] ^ self.eights_b[start_b[left] + at]
            wrong = differ & _MASKS[np.minimum(n[left] - at, 8)] != 0
            same[left[wrong]] = False
            at += 8
            left = left[~wrong & (n[left] > at)]
        return same


def first_equal(hashes: np.ndarray, same) -> np.ndarray:
    """For each item the first item that equals it. ``same(i, j)`` compares pairs of items whose hashes are equal.

    An open-addressing table with linear probing, half full at most, into which all items go at once: in each turn the
    least item takes a free place, items equal to its holder are done, the others go one place on.
    """
    n = len(hashes)
    size = 1 << max(1, (2 * n - 1).bit_length())
    holders = np.full(size, -1, np.int64)
    place = (hashes & np.uint64(size - 1)).astype(np.int64)
    out, left = np.empty(n, np.int64), np.arange(n)
    while len(left):
        at = place[left]
        free = holders[at] < 0
        holders[at[free][::-1]] = left[free][::-1]      # the last one written stays: the least
        holder = holders[at]
        done = holder == left
        maybe = np.flatnonzero(~done & (hashes[holder] == hashes[left]))
        done[maybe[same(left[maybe], holder[maybe])]] = True
        out[left[done]] = holder[done]
        left = left[~done]
        place[left] = (place[left] + 1) & (size - 1)
    return out


class HashSet:
    """A set of 64-bit hashes: an open-addressing table with linear probing, a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.size = 1 << max(1, (4 * len(keys) - 1).bit_length())
        self.index = np.full(self.size, -1, np.int32)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            at = place[left]
            free = self.index[at] < 0
            self.index[at[free]] = left[free]
            left = left[self.index[at] != left]
            place[left] = (place[left] + 1) & (self.size - 1)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        place = self._place(hashes)
        left = np.flatnonzero(self.index[place] >= 0)
        while len(left):
            key = self.index[place[left]]
            found = self.keys[key] == hashes[left]
            out[left[found]] = key[found]
            left = left[~found]
            place[left] = (place[left] + 1) & (self.size - 1)
            left = left[self.index[place[left]] >= 0]
        return out
