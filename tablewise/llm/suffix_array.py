"""Suffix array by two-stage sorting, and common prefixes of neighbours, in numpy.

Stage one sorts only the suffixes that are smaller than their successors: they cut the text into substrings,
each substring is named by its order, and names are joined side by side until all suffixes differ. Stage two scans
the buckets of first symbols from the smallest on; each suffix met puts the suffix before it, if that is larger than
its successor, at the next free place of its own bucket.

Several texts, none of them empty, are sorted together. Each is followed by an end of its own, smaller than any byte, so that no
comparison goes beyond the end of a text.
"""

from __future__ import annotations

import numpy as np

_SYMBOL_BITS, _SYMBOLS = 9, 7       # seven 9-bit symbols in a key: ends, 256 bytes, and "behind the substring"
_BEHIND = (1 << _SYMBOL_BITS) - 1


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends): symbol 0 .. len(texts) - 1 are the ends, which order themselves by position, and
    byte b is len(texts) + b."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = data.astype(np.int32) + np.int32(len(texts))
    ends = starts + lengths
    symbols[ends] = np.arange(len(texts))
    # the last end closes the whole text: it has to be the smallest
    symbols[ends] = (symbols[ends] + 1) % len(texts)
    return symbols, starts, ends


def smaller_than_successor(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol, unique and smallest, counts as such."""
    n = len(symbols)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(symbols[1:] - symbols[:-1])
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]     # the next place where the symbol changes
    return step[known] > 0


def _sorted_small(symbols: np.ndarray, small: np.ndarray, n_ends: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, in order."""
    at = np.flatnonzero(small)
    m = len(at)
    length = np.concatenate([np.diff(at), [0]]) + 1         # up to and with the next of them
    short = np.where(symbols < n_ends, 0, symbols - n_ends + 1).astype(np.uint64)
    padded = np.concatenate([short, np.zeros(_SYMBOLS, np.uint64)])

    def key(items: np.ndarray, chunk: int) -> np.ndarray:
        out = np.zeros(len(items), np.uint64)
        first = at[items] + chunk * _SYMBOLS
        left = length[items] - chunk * _SYMBOLS
        for j in range(_SYMBOLS):
            symbol = padded[np.minimum(first + j, len(padded) - 1)]
            # a substring that ends where another goes on is the larger of the two
            out = (out << np.uint64(_SYMBOL_BITS)) | np.where(j < left, symbol, np.uint64(_BEHIND))
        return out

    # rank: the place of the first of all items that are equal so far
    order = np.argsort(k := key(np.arange(m), 0))
    rank = _ranks(order, k)
    chunk = 1
    items = np.flatnonzero(length >= _SYMBOLS)      # also those that end with the key: the others go on
    while len(items):
        _refine(rank, items, _dense(key(items, chunk)), m)
        chunk += 1
        items = items[length[items] >= chunk * _SYMBOLS]
    # ends inside substrings: an end is the last symbol of a substring and the next item, whose rank decides
    ends = np.flatnonzero(symbols[at] < n_ends)
    rank[ends] = symbols[at[ends]]
    # ranks of ``step`` substrings in a row: the ranks of two or three stretches side by side are those of as many more
    step = 1
    items = _tied(rank, np.arange(m))
    while len(items):
        follow = rank[np.minimum(items + step, m - 1)]
        if m < 1 << 21:
            _refine(rank, items, follow * m + rank[np.minimum(items + 2 * step, m - 1)], m * m)
            step *= 3
        else:
            _refine(rank, items, follow, m)
            step *= 2
        items = _tied(rank, items)
    out = np.empty(m, np.int64)
    out[rank] = at
    return out


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = first
    return rank


def _tied(rank: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Of the items, those that share a rank with another."""
    count = np.bincount(rank, minlength=len(rank))
    return items[count[rank[items]] > 1]


def _dense(keys: np.ndarray) -> np.ndarray:
    """Numbers below len(keys) in the order of the keys."""
    return _ranks(np.argsort(keys), keys)


def _refine(rank: np.ndarray, items: np.ndarray, keys: np.ndarray, below: int) -> None:
    """Split the items of equal rank, all of which are given, by a second key ``below`` a bound."""
    both = rank[items] * below + keys
    order = np.argsort(both)
    both = both[order]
    place = np.arange(len(items))
    group = rank[items[order]]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    split = np.concatenate([[True], both[1:] != both[:-1]])
    start = np.maximum.accumulate(np.where(head, place, 0))
    rank[items[order]] = group + np.maximum.accumulate(np.where(split, place, 0)) - start


def suffix_array(symbols: np.ndarray, n_ends: int) -> np.ndarray:
    """The suffixes of ``joined`` texts in order; the first ``n_ends`` are the ends themselves."""
    n = len(symbols)
    small = smaller_than_successor(symbols)
    direct = _sorted_small(symbols, small, n_ends)
    count = np.bincount(symbols, minlength=n_ends + 256)
    bucket = np.concatenate([[0], np.cumsum(count)])
    small_count = np.bincount(symbols[direct], minlength=n_ends + 256)
    out = np.empty(n, np.int64)
    # in a bucket the suffixes larger than their successors come first, the directly sorted ones last
    tail = bucket[1:] - small_count
    place = np.arange(len(direct)) - np.concatenate([[0], np.cumsum(small_count)])[symbols[direct]]
    out[tail[symbols[direct]] + place] = direct
    free = bucket[:-1].copy()

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if len(before):
            symbol = symbols[before]
            order = np.argsort(symbol, kind="stable")
            symbol, before = symbol[order], before[order]
            added = np.bincount(symbol, minlength=len(free))
            first = np.cumsum(added) - added
            out[free[symbol] + np.arange(len(symbol)) - first[symbol]] = before
            free[:] += added

    induce(out[:n_ends])
    for b in range(n_ends, n_ends + 256):
        if not count[b]:
            continue
        done = bucket[b]
        while done < free[b]:           # a run of one symbol fills its own bucket further
            met = out[done:free[b]]
            done = free[b]
            induce(met)
        induce(out[tail[b]:bucket[b + 1]])
    return out


def common_prefixes(texts_data: np.ndarray, symbols: np.ndarray, order: np.ndarray, ends_of: np.ndarray) -> np.ndarray:
    """For each place of the order, the bytes that its suffix and the one before it have in common.

    A suffix whose preceding symbol equals that of its neighbour shares one byte less than the suffix before it
    in the text; only the others are compared, eight bytes at a time. ``ends_of``: where the text of a position ends.
    """
    n = len(order)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([texts_data, np.zeros(16, np.uint8)]).astype(np.uint64)
    for j in range(8):
        words |= padded[j:j + n + 8] << np.uint64(8 * j)
    known = previous >= 0
    inherits = np.zeros(n, bool)
    inherits[1:] = known[1:] & (previous[1:] > 0) & (symbols[:-1] == symbols[np.maximum(previous[1:] - 1, 0)])
    prefix = np.zeros(n, np.int64)
    items = np.flatnonzero(known & ~inherits)
    limit = np.minimum(ends_of[items] - items, ends_of[previous[items]] - previous[items])
    at = np.zeros(len(items), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        a, b = items[active] + at[active], previous[items[active]] + at[active]
        differ = words[a] ^ words[b]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))
        equal = np.where(same, 8, np.frexp(low.astype(np.float64))[1] - 1 >> 3)
        at[active] += equal
        active = active[same & (at[active] < limit[active])]
    prefix[items] = np.minimum(at, limit)
    source = np.maximum.accumulate(np.where(inherits, -1, np.arange(n)))
    prefix = np.maximum(0, prefix[source] - (np.arange(n) - source))
    return prefix[order]
