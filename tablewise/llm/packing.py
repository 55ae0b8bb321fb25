"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.chunk_table import token_bytes
from tablewise.llm.common import claim_worker, rows_of, with_text

GROUP_DOCS = 4096
CODED = "doc_id bigint, n_ids bigint, sums binary, rest binary, g bigint"
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


class CapacityTree:
    """Bins in order of opening; each inner node holds the largest free capacity below it, so that the first
    bin with room is found, and its capacity changed, in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the first bin with room; its number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        found = node - self.leaves
        tree[node] -= size
        while node > 1:
            node >>= 1
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. Ties in size go by item number."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins = CapacityTree(len(sizes), capacity), []
    for i in order:
        b = tree.take(sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (item, start, length) of the emptiest bins, cut where needed, fill the gaps of the others. One bin
    at most is left with a gap; it is cut into sequences as long as powers of two, which need no padding."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    first, last = 0, len(order) - 1
    while first < last:
        target, source = order[first], order[last]
        gap = capacity - used[target]
        if not gap:
            first += 1
        elif not bins[source]:
            last -= 1
        else:
            item, start, length = bins[source].pop()
            take = min(gap, length)
            bins[target].append((item, start, take))
            if take < length:
                bins[source].append((item, start + take, length - take))
            used[target] += take
            used[source] -= take
    full = [bins[b] for b in order if bins[b] and used[b] == capacity]
    for b in order:
        if bins[b] and used[b] < capacity:
            rest, left = used[b], bins[b]
            while rest:
                size = 1 << (rest.bit_length() - 1)
                rest -= size
                sequence = []
                while size:
                    item, start, length = left.pop(0)
                    take = min(size, length)
                    sequence.append((item, start, take))
                    if take < length:
                        left.insert(0, (item, start + take, length - take))
                    size -= take
                full.append(sequence)
    return full


def pack_rests(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold what follows the full sequences of each item: packed by
    first-fit decreasing; what padding that leaves is filled."""
    rests = [(i, n - n % capacity, n % capacity) for i, n in enumerate(lengths) if n % capacity]
    bins = first_fit_decreasing([r[2] for r in rests], capacity)
    return fill([[rests[i] for i in b] for b in bins], capacity)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, special: bool,
            capacity: int) -> Iterator[pa.RecordBatch]:
    """What a group must know of a document: the checksums of its full sequences and the ids behind them."""
    claim_worker("packing")
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for rows in rows_of(batches):
        n_ids, sums, rests = [], [], []
        for coded in token_bytes(rows.column("text").to_pylist(), path, spaces=True, special=special):
            ids = memoryview(coded + end)
            full = len(ids) - len(ids) % size
            n_ids.append(len(ids) // 4)
            sums.append(np.array([zlib.crc32(ids[s:s + size]) for s in range(0, full, size)], "<u4").tobytes())
            rests.append(_narrow(bytes(ids[full:])))
        yield pa.record_batch([rows.column("doc_id"), pa.array(n_ids, pa.int64()), pa.array(sums, pa.binary()),
                               pa.array(rests, pa.binary()), rows.column("g")], names=names_of(CODED))


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _narrow(ids: bytes) -> bytes:
    """Two bytes for each id where all are below 65,535, marked by a leading byte."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 65_535 else b"\4" + ids


def _widened(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def _full_sequences(n_ids: np.ndarray, sums: list[bytes], capacity: int) -> tuple[np.ndarray, ...]:
    """(item, start, length, checksum, offset) of the sequences that one item fills alone, in order."""
    count = n_ids // capacity
    item = np.repeat(np.arange(len(n_ids)), count)
    before = np.repeat(np.cumsum(count) - count, count)
    start = (np.arange(len(item)) - before) * capacity
    return (item, start, np.full(len(item), capacity), np.frombuffer(b"".join(sums), "<u4"),
            np.zeros(len(item), np.int64))


def _pack(group: int, rows: pa.Table, capacity: int) -> pa.Table:
    rows = rows.sort_by("doc_id")
    n_ids = rows.column("n_ids").to_numpy()
    full = _full_sequences(n_ids, rows.column("sums").to_pylist(), capacity)
    rests = [_widened(b) for b in rows.column("rest").to_pylist()]
    pieces, numbers = [], []
    for s, sequence in enumerate(pack_rests(n_ids.tolist(), capacity), len(full[0])):
        offset = 0
        for item, start, length in sequence:
            at = start % capacity
            pieces.append((item, start, length, zlib.crc32(rests[item][at:at + length].tobytes()), offset))
            numbers.append(s)
            offset += length
    cut = np.array(pieces, np.int64).reshape(-1, 5).T
    item, start, length, crc, offset = (np.concatenate([a.astype(np.int64), b]) for a, b in zip(full, cut))
    sequence = (group << 32) + np.concatenate([np.arange(len(full[0])), np.array(numbers, np.int64)])
    doc_ids = rows.column("doc_id").take(pa.array(item))
    return pa.table([doc_ids, *map(pa.array, (start, length, crc, n_ids[item], sequence, offset))],
                    names=names_of(PIECES))


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS,
         id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Pieces of documents, laid into sequences of ``capacity`` ids.

    Each document is its ids and ``end_id``; every id lies in exactly one piece. Documents are dealt into groups
    of about ``group_docs`` by a hash of id and text, and each group is packed on its own, so that a task holds
    one group, whatever the size of the table. Sequences that one document fills alone are cut where it is encoded;
    only their checksums and the fewer than ``capacity`` ids behind them travel to the group, two bytes an id as a
    rule. So a group of 4,096 documents holds some 8 MB of ids, however long the documents are. ``special``: see
    ``token_bytes``.

    Defined results: a missing or empty text is the end id alone; repeated rows are packed each for itself; a
    missing doc_id stays missing; equal lengths are packed in order of doc_id; an empty table gives no rows.
    """
    groups = max(1, ceil(df.count() / group_docs))
    coded = with_text(df, id_col, text_col).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    encoded = coded.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id, special=special, capacity=capacity),
                               CODED)

    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _pack(key[0].as_py(), rows, capacity)

    return encoded.groupBy("g").applyInArrow(packed, PIECES)
