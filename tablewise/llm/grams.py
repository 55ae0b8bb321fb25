"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Hashes are a polynomial over the bytes, modulo 2^64, with a final mixing: equal on every machine and in every
run. Two different words of one comparison share a hash with probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20          # bytes hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: ASCII white space, the separators of words
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = np.ones(256, bool)
WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Runs of letters: ASCII letters and all bytes of characters beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept and enlarged."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]).cumprod(dtype=np.uint64)
                            for b in (_BASE, _INVERSE))
    return _powers


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts without nulls: text i is bytes[bounds[i]:bounds[i + 1]]."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): runs of bytes that are ``inside``, none across texts; the runs of text i are
    first[i]:first[i + 1]."""
    token = np.zeros(len(data) + 2, bool)
    token[1:-1] = inside[data]
    start, end = token[1:] & ~token[:-1], ~token[1:] & token[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[token[cuts] & token[cuts + 1]]
    start[cuts] = end[cuts] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[starts[i]:ends[i]] for ascending starts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        origin = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, origin + PIECE)))
        piece = data[origin:ends[i:j].max()]
        power, inverse = power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[piece] * power[:len(piece)], out=total[1:])
        s, e = starts[i:j] - origin, ends[i:j] - origin
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the words of text i, separated by ASCII white space, are hashes[first[i]:first[i + 1]]."""
    data, bounds = layout(column)
    starts, ends, first = spans(data, bounds)
    return hash_spans(LOWER[data] if lower else data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the runs of ``size`` words; a text with fewer words has its whole sequence as one, a
    text without words has none."""
    n = np.diff(first)
    whole = max(0, len(words) - size + 1)
    value = np.zeros(whole, np.uint64)
    for j in range(size):
        value = value * _BASE + words[j:j + whole]
    value = mix(value + np.uint64(size))
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + np.arange(len(text)) - out_first[text]
    out = value[np.minimum(at, whole - 1)] if whole else np.zeros(len(text), np.uint64)
    for i in np.flatnonzero((n > 0) & (n < size)):
        short = 0
        for w in words[first[i]:first[i + 1]].tolist():
            short = short * int(_BASE) + w
        out[out_first[i]] = mix(np.array([(short + int(n[i])) % (1 << 64)], np.uint64))[0]
    return out, out_first
