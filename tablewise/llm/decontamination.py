"""Benchmark decontamination: which words of a document stand in a word window of a benchmark item.

The windows of the benchmark, normalised to lower-case words, are a broadcast hash set; the windows of every document
are looked up in it while the document is read, and what is found is compared word by word. Documents do not move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import claim_worker, free_names, rows_of, small, text_digest, with_text
from tablewise.llm.grams import LOWER, hash_spans, layout, mix, spans
from tablewise.llm.spans import Comparison, HashSet
from tablewise.sources.staging import stage

#: Fixed: a word is a run of digits, ASCII letters and characters beyond ASCII
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
WINDOW = 10

#: Normalised benchmark text that is broadcast at once; a larger benchmark takes several scans of the documents.
BLOCK_BYTES = 8 << 20
#: New words of a segment of an item
SEGMENT_WORDS = 4096
_FACTOR = np.uint64(0xD1342543DE82EF95)

RUN = "struct<first_word:bigint,end_word:bigint,start:bigint,end:bigint>"
_RUN_TYPE = pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "start", "end")])
FOUND = f"doc_id bigint, digest bigint, n_words bigint, runs array<{RUN}>, items array<string>"


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all runs of ``size`` words inside one text."""
    n = max(0, len(words) - size + 1)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value = value * _FACTOR + words[j:j + n]
    last = np.repeat(first[1:] - size, np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) <= last)
    return mix(value[at] + np.uint64(size)), at


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, bounds of the texts, starts and ends of the words, first word of each text)."""
    data, bounds = layout(column)
    data = LOWER[data]
    starts, ends, first = spans(data, bounds, WORD)
    return data, bounds, starts, ends, first


def _segments(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as normalised texts of some thousand words; neighbours share ``size`` - 1 words, so that no window is lost."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            data, _, starts, ends, first = _words(rows.column("text"))
            raw, out = data.tobytes(), []
            for item, a, b in zip(rows.column("item").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                for s in range(a, max(b - size + 1, min(a + 1, b)), SEGMENT_WORDS):
                    e = min(b, s + SEGMENT_WORDS + size - 1)
                    words = [raw[x:y] for x, y in zip(starts[s:e].tolist(), ends[s:e].tolist())]
                    out.append((item, min(size, e - s), b" ".join(words).decode("utf-8", "replace")))
            items, sizes, texts = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())],
                                  names=["item", "size", "text"])

    return cut


@dataclass
class Windows:
    """The windows of one size of a block of the benchmark. Key i of the set has the runs key_first[i]:key_first[i + 1],
    one unless hashes collide; run r is the window from word run_word[r] on, of the items run_first[r]:run_first[r + 1]."""

    size: int
    keys: HashSet
    key_first: np.ndarray
    run_word: np.ndarray
    run_first: np.ndarray
    run_items: np.ndarray


@dataclass
class Block:
    """What is broadcast: normalised texts, their words, the windows, and the ids of the items in ascending order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    windows: list[Windows]
    items: list[str]


def benchmark_block(segments: pa.Table) -> Block:
    """The hash set of a block of segments (item, size, text)."""
    segments = segments.combine_chunks()
    text = segments.column("text").chunk(0) if len(segments) else pa.array([], pa.string())
    data, bounds, starts, ends, first = _words(text)
    hashes = hash_spans(data, starts, ends)
    ids = segments.column("item").to_pylist()
    items = sorted({i for i in ids if i is not None})
    number = {i: k for k, i in enumerate(items)}
    item = np.array([number.get(i, -1) for i in ids], np.int64)
    size_of = segments.column("size").to_numpy()
    segment = np.repeat(np.arange(len(ids)), np.diff(first))
    compare, windows = Comparison(data), []
    for size in sorted(set(size_of.tolist())):
        value, word = window_hashes(hashes, first, size)
        mine = size_of[segment[word]] == size
        value, word = value[mine], word[mine]
        order = np.argsort(value, kind="stable")
        value, word = value[order], word[order]
        same_key = value[1:] == value[:-1]
        same = same_key.copy()
        for j in range(size):
            at = np.flatnonzero(same)
            a, b = word[1:][at] + j, word[:-1][at] + j
            same[at] = compare.equal(starts[a], ends[a], starts[b], ends[b])
        new_run = np.concatenate([[True], ~same]) if len(value) else np.zeros(0, bool)
        run = np.cumsum(new_run) - 1
        new_key = np.concatenate([[True], ~same_key]) if len(value) else np.zeros(0, bool)
        pairs = np.unique(np.stack([run, item[segment[word]]], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        heads = np.flatnonzero(new_run)
        key_first = np.append(run[new_key], len(heads))
        windows.append(Windows(size, HashSet(value[new_key]), key_first, word[heads],
                               np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), pairs[:, 1]))
    return Block(data, starts, ends, windows, items)


def _hits(block: Block, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(covered, docs, items): is each word inside a verified window; pairs of a text and an item of the block, ascending."""
    hashes = hash_spans(data, starts, ends)
    edge = np.zeros(len(starts) + 1, np.int64)
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    compare, pairs = None, [np.zeros((0, 2), np.int64)]
    for w in block.windows:
        value, word = window_hashes(hashes, first, w.size)
        key = w.keys.find(value)
        at = np.flatnonzero(key >= 0)
        if not len(at):
            continue
        word, key = word[at], key[at]
        run = w.key_first[key]
        while len(word):
            # neighbouring windows share their words: each pair of words is compared once
            mine = (word[:, None] + np.arange(w.size)).ravel()
            theirs = (w.run_word[run][:, None] + np.arange(w.size)).ravel()
            pair, back = np.unique(mine * len(block.starts) + theirs, return_inverse=True)
            a, b = pair // len(block.starts), pair % len(block.starts)
            compare = compare or Comparison(data, block.data)
            equal = compare.equal(starts[a], ends[a], block.starts[b], block.ends[b])[back].reshape(-1, w.size).all(1)
            np.add.at(edge, word[equal], 1)
            np.add.at(edge, word[equal] + w.size, -1)
            hit = np.unique(np.stack([doc_of[word[equal]], run[equal]], 1), axis=0)
            n = w.run_first[hit[:, 1] + 1] - w.run_first[hit[:, 1]]
            here = np.repeat(w.run_first[hit[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(hit[:, 0], n), w.run_items[here]], 1))
            more = run + 1 < w.key_first[key + 1]       # other windows of the same hash, or the same window apart
            word, key, run = word[more], key[more], run[more] + 1
    found = np.unique(np.concatenate(pairs), axis=0)
    return np.cumsum(edge[:-1]) > 0, found[:, 0], found[:, 1]


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("decontamination")
        block: Block = shared.value
        for rows in rows_of(batches):
            data, bounds, starts, ends, first = _words(rows.column("text"))
            covered, docs, items = _hits(block, data, starts, ends, first)
            n = len(first) - 1
            fences = np.zeros(len(covered) + 1, bool)
            fences[first] = True
            inside = np.concatenate([[False], covered, [False]])
            opens = np.flatnonzero(covered & (~inside[:-2] | fences[:-1]))
            closes = np.flatnonzero(covered & (~inside[2:] | fences[1:]))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(opens) else np.zeros(1, np.int64)
            text = np.searchsorted(first, opens, "right") - 1
            before, words_before = points[bounds[text]] if len(opens) else text, first[text]
            runs = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (
                    opens - words_before, closes + 1 - words_before,
                    points[starts[opens]] - before if len(opens) else opens,
                    points[ends[closes]] - before if len(opens) else opens)], fields=list(_RUN_TYPE))
            run_first = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            item_first = np.searchsorted(docs, np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch([
                rows.column("doc_id"), rows.column("digest"), pa.array(np.diff(first), pa.int64()),
                pa.ListArray.from_arrays(run_first, runs),
                pa.ListArray.from_arrays(item_first, pa.array([block.items[i] for i in items.tolist()], pa.string())),
            ], names=["doc_id", "digest", "n_words", "runs", "items"])

    return scan


def merge_runs(runs: list[dict]) -> list[dict]:
    """Runs of words found by several scans as the least number of runs."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first_word"], r["end_word"])):
        if out and r["first_word"] <= out[-1]["end_word"]:
            if r["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": r["end_word"], "end": r["end"]}
        else:
            out.append(dict(r))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        runs = [merge_runs([r for part in parts for r in part]) for parts in rows.column("runs").to_pylist()]
        items = [sorted({i for part in parts for i in part}) for parts in rows.column("items").to_pylist()]
        yield pa.record_batch([rows.column("doc_id"), rows.column("digest"), rows.column("n_words"),
                               pa.array(runs, pa.list_(_RUN_TYPE)), pa.array(items, pa.list_(pa.string()))],
                              names=["doc_id", "digest", "n_words", "runs", "items"])


def find_overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, digest, n_words, n_hit, runs, items.

    Words are runs of digits, letters and characters beyond ASCII, A to Z in lower case. A window is ``window``
    consecutive words of an item; an item of fewer words is one window. Words inside an occurrence of a window are
    hit; ``runs`` are the maximal runs of hit words, as words and as code points of the text; ``items`` the ids,
    as text and ascending, of the items that have an occurring window. ``digest`` tells texts of one id apart.

    The benchmark is cut into segments and broadcast in blocks of some ``block_bytes`` (one segment at least): usually
    one, and the documents are scanned once, without a shuffle. With more, each block is a scan of its own, and only
    documents with hits meet in a shuffle.

    Defined results: a missing text, of a document or an item, has no words; a document without an id is scanned like
    any other; an item without an id marks words but is in no list; rows of one item id are one item; repeated
    rows are documents of their own with equal results; an empty table of documents gives no rows, an empty
    benchmark no hits.
    """
    spark = df.sparkSession
    docs = with_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("digest", text_digest("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    segments = stage(items.mapInArrow(_segments(window), "item string, size int, text string").distinct(),
                     "benchmark-segments")
    n_bytes = segments.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    scans = []
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(benchmark_block(segments.where(block == k).toArrow()))
        found = docs.mapInArrow(_scan(shared), FOUND)
        scans.append(found if blocks == 1 else stage(found if k == 0 else found.where("size(runs) > 0"), "benchmark-hits"))
    if blocks == 1:
        merged = scans[0]
    else:
        key = ["doc_id", "digest", "n_words"]
        hits = scans[0].where("size(runs) > 0")
        for scan in scans[1:]:
            hits = hits.unionByName(scan)
        together = hits.distinct().groupBy(*key).agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
        hits = stage(together.mapInArrow(_merged, FOUND), "benchmark-merged").select(
            F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.col("runs").alias("hit_runs"),
            F.col("items").alias("hit_items"))
        merged = scans[0].join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")),
                               "left").select(*key, F.coalesce("hit_runs", "runs").alias("runs"),
                                              F.coalesce("hit_items", "items").alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end_word"] - r["first_word"])
    return merged.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), "runs", "items")


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), runs.to_pylist()):
        if text is not None and gone is not None and len(gone):
            edges = [0, *(x for r in gone for x in (r["start"], r["end"])), len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(df: DataFrame, benchmark: DataFrame, documents: bool = False, id_col: str = "doc_id",
                  text_col: str = "text", **how) -> DataFrame:
    """The documents with all their columns, without what ``find_overlaps`` hits: the runs of hit words are cut from
    their texts, or, with ``documents``, a document with a hit goes. A missing text stays missing. What is joined are
    the contaminated documents, broadcast if they are few.
    """
    names = free_names(df, "hit_id", "hit_digest", "hit_runs")
    found = find_overlaps(df, benchmark, id_col, text_col, **how).where("n_hit > 0").select("doc_id", "digest", "runs")
    hits = stage(found.dropDuplicates(["doc_id", "digest"]), "contaminated").toDF(*names)
    same = df[id_col].cast("bigint").eqNullSafe(F.col(names[0])) & (text_digest(text_col) == F.col(names[1]))
    if documents:
        return df.join(small(hits.drop(names[2])), same, "left_anti")
    cut = F.when(F.col(names[2]).isNull(), F.col(text_col)).otherwise(_without(text_col, names[2]))
    # spans may be many: only the digests are known to be small
    return df.join(hits, same, "left").withColumn(text_col, cut).drop(*names)
