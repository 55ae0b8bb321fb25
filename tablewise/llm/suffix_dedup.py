"""Removal of every byte that a long repeated string covers.

1. Of every window of 400 bytes, one gram of 48 bytes is chosen by its hash alone (the least, the rightmost of
   equals): its place is the window's anchor. Equal windows choose the same gram at the same distance, and the windows
   of one anchor are consecutive: an anchor with the bytes of its windows is a context.
2. Contexts whose gram the corpus has once are dropped; equal contexts are one, with a count.
3. All contexts of a gram go to the same bucket. A task sorts all suffixes of a bucket's contexts and takes the
   common prefixes of neighbours; 400 bytes or more are a repeat.
4. Grams of more contexts than a bucket may hold are cut further: by ranges of distances from the anchor, with the
   part that all windows of a range share, and what that leaves open by single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import (
    back_to_names,
    carried,
    carried_names,
    carried_schema,
    claim_worker,
    rows_of,
    with_carried,
    with_text,
)
from tablewise.llm.grams import BYTE_VALUES, layout, mix, power_tables
from tablewise.llm.suffix_array import common_prefixes, joined, suffix_array
from tablewise.sources.staging import stage

LENGTH = 400
GRAM = 48
PIECE = 1 << 19          # bytes whose anchors are chosen at once
BUCKET_CONTEXTS = 1000   # contexts of a bucket on average: 600 KB of text
MOST_CONTEXTS = 1000     # contexts of one gram in a bucket; beyond, the gram is cut further
RANGE = 16               # distances of a range
OWN_BUCKET = 150         # a gram with more contexts has a bucket of its own
BROADCAST_ROWS = 1_500_000   # 64 MB of contexts or spans; beyond that an ordinary join brings them to their documents

#: What tells documents apart: rows that share an id may have different texts
KEY = "struct<id:bigint,text:bigint>"
ANCHORS = f"doc_id {KEY}, h bigint, digest bigint, at bigint"
#: ``at`` is position of the anchor << 32 | bytes from its first window's start to it << 16 | number of its windows
_POSITION, _LEFT = 32, 16
_LOW = (1 << _LEFT) - 1
LONGEST = 1 << _LEFT


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on."""
    power, inverse = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:len(data)], out=total[1:])
    n = len(data) - size + 1
    return mix((total[size:] - total[:n]) * inverse[:n])


def window_least(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive keys: running minima from both ends of blocks of that size."""
    n = len(keys)
    rows = -(-n // size)
    blocks = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(rows, size)
    right = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n - size + 1], right[size - 1:n])


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, first windows, numbers of windows) of the anchors of the windows of ``length`` bytes that
    start where ``valid``."""
    hashes = gram_hashes(data, gram)
    width = np.uint64(max(1, len(hashes) - 1).bit_length())
    mask = (np.uint64(1) << width) - np.uint64(1)
    keys = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
    start = np.flatnonzero(valid[:len(data) - length + 1])
    chosen = (mask - (window_least(keys, length - gram + 1)[start] & mask)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[head], hashes[chosen[head]], start[head], np.diff(np.append(head, len(start)))


def _pieces(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, valid): stretches of bytes that together have every window of every text."""
    valid = np.zeros(len(data) + 1, np.int64)
    long_ = np.diff(bounds) >= length
    np.add.at(valid, bounds[:-1][long_], 1)
    np.add.at(valid, bounds[1:][long_] - length + 1, -1)
    valid = np.cumsum(valid)[:len(data)] > 0
    for start in range(0, len(data), PIECE):
        stop = min(len(data), start + PIECE + length - 1)
        own = valid[start:stop].copy()
        own[PIECE:] = False
        if stop - start >= length and own.any():
            yield start, stop, own


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    claim_worker("suffix_dedup")
    from xxhash import xxh3_64_intdigest

    for rows in rows_of(batches):
        data, bounds = layout(rows.column("text"))
        found = []
        for start, stop, valid in _pieces(data, bounds, length):
            at, h, first, n = anchors(data[start:stop], valid, length, gram)
            found.append((at + start, h, first + start, n))
        if not found:
            continue
        at, h, first, n = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(bounds, at, side="right") - 1
        left = at - first
        view = memoryview(np.ascontiguousarray(data))
        digest = np.array([xxh3_64_intdigest(view[a:b], seed) for a, b, seed in
                           zip(first.tolist(), (first + n + length - 1).tolist(), left.tolist())], np.uint64)
        packed = (at - bounds[text] << _POSITION) + (left << _LEFT) + n
        yield pa.record_batch([rows.column("doc_id").take(pa.array(text)), pa.array(h.view(np.int64)),
                               pa.array(digest.view(np.int64)), pa.array(packed)],
                              names=["doc_id", "h", "digest", "at"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that the rows (doc_id, text, wanted) list."""
    claim_worker("suffix_dedup")
    for rows in rows_of(batches):
        out = []
        for text, wanted in zip(rows.column("text").to_pylist(), rows.column("wanted").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                at, left, n = w["at"] >> _POSITION, w["at"] >> _LEFT & _LOW, w["at"] & _LOW
                context = data[at - left:at - left + n + length - 1]
                out.append((w["h"], w["digest"], w["copies"], w["bucket"], left, context))
        if out:
            names = ["h", "digest", "copies", "bucket", "left", "context"]
            types = [*[pa.int64()] * 5, pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


CONTEXTS = "h bigint, digest bigint, copies bigint, bucket bigint, left bigint, context binary"
SPANS = "h bigint, digest bigint, first bigint, last bigint"
RANGES = "h bigint, digest bigint, range bigint, first bigint, last bigint, inner bigint, outer bigint"


def repeated_windows(contexts: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows of ``length`` bytes that two contexts have, or one has twice, or one that
    stands for several copies. No two contexts hold the same window of a document."""
    symbols, starts, ends = joined(contexts)
    order = suffix_array(symbols, len(contexts))
    context = np.repeat(np.arange(len(contexts)), ends - starts + 1)
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    common = common_prefixes(data, symbols, order, ends[context])
    first = np.flatnonzero(common < length)         # neighbours that share a window are a run; a run starts here
    size = np.diff(np.append(first, len(order)))
    of = context[order]
    several = (size > 1) | (np.maximum.reduceat(copies[of], first) > 1)
    hit = order[np.repeat(several, size) & (ends[of] - order >= length)]
    return context[hit], hit - starts[context[hit]]


def _spans(context: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of runs of offsets."""
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    head = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    tail = np.concatenate([head[1:], [len(context)]]) - 1
    return context[head], offset[head], offset[tail]


def _search(rows: pa.Table, length: int) -> pa.Table:
    claim_worker("suffix_dedup")
    rows = rows.sort_by([("h", "ascending"), ("digest", "ascending")])
    context, offset = repeated_windows(rows.column("context").to_pylist(), rows.column("copies").to_numpy(), length)
    names = [c.split()[0] for c in SPANS.split(", ")]
    if not len(context):
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    context, first, last = _spans(context, offset)
    h, digest, left = (rows.column(c).to_numpy()[context] for c in ("h", "digest", "left"))
    return pa.table([pa.array(h), pa.array(digest), pa.array(first - left), pa.array(last - left)], names=names)


def _ranges(left: int, windows: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, last): the distances of a context's windows, cut at multiples of RANGE."""
    first, highest = -left, windows - 1 - left
    while first <= highest:
        number = first // RANGE
        last = min(highest, number * RANGE + RANGE - 1)
        yield number, first, last
        first = last + 1


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts -> a row for each range of distances: a digest of the part that all windows of the whole range share,
    whichever of them the context has, and one of all bytes of the windows that it has."""
    from xxhash import xxh3_64_intdigest

    names = [c.split()[0] for c in RANGES.split(", ")]
    for rows in batches:
        out = []
        for h, digest, left, context in zip(*(rows.column(c).to_pylist() for c in ("h", "digest", "left", "context"))):
            for number, first, last in _ranges(left, len(context) - length + 1):
                at = left + number * RANGE
                inner = xxh3_64_intdigest(context[at + RANGE - 1:at + length], 1)
                outer = xxh3_64_intdigest(context[left + first:left + last + length], 2)
                out.append((h, digest, number, first, last, inner - (1 << 63), outer - (1 << 63)))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts with a list of open ranges -> (h, digest, distance, window): a digest of each window."""
    from xxhash import xxh3_64_intdigest

    names = ["h", "digest", "distance", "window"]
    for rows in batches:
        out = []
        for h, digest, left, context, open_ in zip(*(rows.column(c).to_pylist() for c in (
                "h", "digest", "left", "context", "open"))):
            for number, first, last in _ranges(left, len(context) - length + 1):
                if number in open_:
                    for d in range(first, last + 1):
                        window = xxh3_64_intdigest(context[left + d:left + d + length])
                        out.append((h, digest, d, window - (1 << 63)))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=names)


def _kept(batches: Iterator[pa.RecordBatch], length: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        out = []
        for text, spans in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for s in sorted((s["first"], s["last"] + length) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            cuts = [0, *(x for r in runs for x in r), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            out.append((len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in runs], kept))
        n, removed, runs, kept = zip(*out)
        shown = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(
            kept, pa.binary())
        yield pa.record_batch(
            [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             shown, pa.array([sha256(k).hexdigest() for k in kept]), *carried(rows)],
            names=["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256", *carried_names(rows)])


KEPT = ("doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, "
        "kept {kind}, kept_sha256 string")


def document_key(id_: Column, text: Column) -> Column:
    return F.struct(id_.cast("bigint").alias("id"), F.xxhash64(text).alias("text"))


class RepeatSearch:
    """The steps of the search over documents (doc_id, text), each written to the shared folder."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int | None = None,
                 bucket_contexts: int = BUCKET_CONTEXTS, most_contexts: int = MOST_CONTEXTS):
        if not 2 <= length < LONGEST:
            raise ValueError(f"repeats have 2 to {LONGEST - 1} bytes")
        self.docs, self.length = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text"), length
        self.gram = gram or min(GRAM, max(1, length * 4 // 5))
        self.bucket_contexts, self.most_contexts = bucket_contexts, most_contexts

    def candidates(self) -> DataFrame:
        """The anchors whose gram the corpus has twice or more. The grams are written before the join: a join of two
        written tables is one whose hot keys Spark deals to several tasks, a join of a count is not."""
        found = stage(self.docs.where("doc_id.id is not null").mapInArrow(
            partial(_anchors, length=self.length, gram=self.gram), ANCHORS), "anchors")
        twice = stage(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "grams-repeated")
        return stage(found.join(twice, "h"), "anchors-repeated")

    def contexts(self, candidates: DataFrame) -> DataFrame:
        """(h, digest, copies, doc_id, at, kinds): each context once, with the number of contexts of its gram."""
        once = candidates.groupBy("h", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "at")).alias("first"))
        once = stage(once.select("h", "digest", "copies", "first.doc_id", "first.at"), "contexts")
        kinds = stage(once.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")), "contexts-kinds")
        return stage(once.join(kinds, "h"), "contexts-counted")

    def with_bytes(self, contexts: DataFrame) -> DataFrame:
        lists = stage(contexts.groupBy("doc_id").agg(
            F.collect_list(F.struct("h", "digest", "copies", "bucket", "at")).alias("wanted")), "contexts-wanted")
        wanted = F.broadcast(lists) if contexts.count() <= BROADCAST_ROWS else lists
        return self.docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(
            partial(_contexts, length=self.length), CONTEXTS)

    def sorted_spans(self, contexts: DataFrame) -> DataFrame:
        """Repeats among contexts by suffix sorting. A gram's contexts are in one bucket, which a gram with many has for
        itself, so that no bucket has many more contexts than ``most_contexts``."""
        buckets = max(1, contexts.count() // self.bucket_contexts)
        length = self.length

        def searched(rows: pa.Table) -> pa.Table:
            return _search(rows, length)

        bucket = F.when(F.col("kinds") > OWN_BUCKET, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(buckets)))
        rows = self.with_bytes(contexts.withColumn("bucket", bucket))
        return rows.groupBy("bucket").applyInArrow(searched, SPANS)

    def cut_spans(self, contexts: DataFrame) -> DataFrame:
        """Repeats among the contexts of grams with very many, exact and without gathering them.

        Contexts with equal bytes in a range repeat in all its windows. Where contexts of a gram agree in the part
        that the windows of a range share, but not in all of it, the windows of one context of each kind are counted
        one by one. All counts are summed up before the shuffle as well."""
        rows = stage(self.with_bytes(contexts.withColumn("bucket", F.lit(0).cast("bigint"))), "contexts-hot")
        cut = stage(rows.mapInArrow(partial(_cut, length=self.length), RANGES), "ranges")
        by = ["h", "range", "inner"]
        kinds = stage(cut.groupBy(*by, "first", "last", "outer").agg(
            F.count(F.lit(1)).alias("same"), F.min("digest").alias("digest")), "ranges-kinds")
        mixed = stage(kinds.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "ranges-mixed")
        whole = cut.join(kinds.where("same > 1").drop("same", "digest"), [*by, "first", "last", "outer"]).select(
            "h", "digest", "first", "last")
        lists = kinds.join(mixed, by).groupBy("h", "digest").agg(F.collect_set("range").alias("open"))
        windows = stage(rows.join(lists, ["h", "digest"]).select("h", "digest", "left", "context", "open").mapInArrow(
            partial(_windows, length=self.length), "h bigint, digest bigint, distance bigint, window bigint"), "windows")
        again = stage(windows.groupBy("h", "distance", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                      "windows-repeated")
        single = windows.join(again, ["h", "distance", "window"]).select(
            "h", "digest", F.col("distance").alias("first"), F.col("distance").alias("last"))
        return merged(whole.union(single), ["h", "digest"])

    def spans(self, candidates: DataFrame) -> DataFrame:
        """(h, digest, first, last): distances from the anchor at which repeated windows of a context start."""
        contexts = self.contexts(candidates)
        left, windows = F.shiftright("at", _LEFT).bitwiseAND(F.lit(_LOW)), F.col("at").bitwiseAND(F.lit(_LOW))
        copied = contexts.where("copies > 1").select(
            "h", "digest", (-left).alias("first"), (windows - 1 - left).alias("last"))
        compared = contexts.where("kinds > 1")
        few = self.sorted_spans(compared.where(F.col("kinds") <= self.most_contexts))
        found = copied.union(few)
        hot = compared.where(F.col("kinds") > self.most_contexts)
        return found if hot.isEmpty() else found.union(self.cut_spans(hot))

    def of_documents(self) -> DataFrame:
        """(doc_id, spans): where repeated windows of each document start, first and last of each run."""
        candidates = self.candidates()
        spans = stage(self.spans(candidates), "spans")
        position = F.shiftright("at", _POSITION)
        placed = candidates.join(spans, ["h", "digest"]).select(
            "doc_id", (position + F.col("first")).alias("first"), (position + F.col("last")).alias("last"))
        return stage(merged(placed, ["doc_id"]).groupBy("doc_id").agg(
            F.collect_list(F.struct("first", "last")).alias("spans")), "document-spans")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, first, last): runs of window starts, overlapping and adjacent ones made one."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before: Column = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1)))
    numbered = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept, kept_sha256, *carry): each document without the bytes that a
    string of ``length`` bytes covers which starts at another place too, of the same document or any other.

    Texts are UTF-8 bytes; ``removed`` are the maximal runs as [start, end), ``kept`` the other bytes, which may
    begin or end within a character; ``as_text`` gives the whole characters among them instead. No gram, context or
    document is left out; a gram with more contexts than a bucket holds takes another, exact way. Only anchors (one in
    about 180 bytes) and contexts of repeated grams travel. ``carry`` names columns that come along unchanged; those
    called like a result column are refused.

    Defined results: a missing text is empty; repeated rows are documents of their own, and repeat each other; texts
    that share an id are told apart by a digest; a document without id takes no part and keeps all its bytes, and so does
    a text below ``length`` bytes; an empty table gives no rows; ``length`` is 2 to 65,535.
    """
    spans = RepeatSearch(with_text(df, id_col, text_col), length).of_documents()
    size = spans.select(F.sum(F.size("spans"))).first()[0] or 0
    lists = F.broadcast(spans) if size <= BROADCAST_ROWS else spans
    docs = with_carried(df, carry, ["doc_id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"],
                        F.col(id_col).alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = docs.withColumn("of", document_key(F.col("doc_id"), F.col("text"))).join(
        lists.withColumnRenamed("doc_id", "of"), "of", "left").drop("of")
    cleaned = joined.mapInArrow(
        partial(_kept, length=length, as_text=as_text),
        carried_schema(KEPT.format(kind="string" if as_text else "binary"), docs))
    return back_to_names(cleaned, carry)
