"""Benchmark decontamination against brute force over lists of words."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewise.llm import decontamination
from tablewise.llm.decontamination import BLOCK_BYTES, benchmark_block, decontaminate, find_overlaps, merge_runs
from tablewise.llm.spans import Comparison, HashSet, first_equal

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, `hit_id` string, `Hit_Runs` string, digest string, items string"


def brute(docs, items, size=10):
    """doc_id -> (words, hit words, ids of items) from all windows as tuples of words."""
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out[doc] = len(words), len(hit), sorted(found)
    return out


def prose(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "_"]) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in "xyz9ß"] + ["日本", "Q"]
    out = [(i, prose(rng, rng.randint(12, 40), vocabulary)) for i in range(25)]
    out += [(25, "only four words here"), (26, ""), (27, None), (28, "!!! ..."), (29, "One-Two"), (30, out[0][1]),
            (31, prose(rng, 9, vocabulary)), (32, prose(rng, 10, vocabulary)), (4, prose(rng, 15, vocabulary))]
    return out


@pytest.fixture(scope="module")
def docs(items):
    rng = random.Random(4)
    vocabulary = ["so", "it", "Goes", "on", "ax", "bz", "日本"]
    out = [None, "", "...", "one", "ONE two", "one two three", "only four\nwords, HERE", "onlyfour words here", "x" * 5000]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 30), vocabulary)]
        for _ in range(rng.randint(0, 4)):
            words = WORD.findall(rng.choice(items)[1] or "")
            a = rng.randrange(max(1, len(words) - 8))
            passage = words[a:a + rng.randint(5, 30)]
            parts += [" ".join(w.upper() if rng.random() < .3 else w for w in passage), prose(rng, rng.randint(0, 12), vocabulary)]
        out.append(" | ".join(parts))
    out.append(prose(rng, 20_000, vocabulary) + " ".join(WORD.findall(items[3][1])) + prose(rng, 20_000, vocabulary))
    return [(i * 7 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def tables(spark, docs, items):
    rows = [(d, t, "a", "b", "c", "d") for d, t in docs]
    return (spark.createDataFrame(rows, SCHEMA).repartition(3).cache(),
            spark.createDataFrame(items, "item_id bigint, text string").cache())


@pytest.mark.parametrize("block_bytes", [BLOCK_BYTES, 700])
def test_hits_and_items(tables, docs, items, block_bytes):
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
             for r in find_overlaps(*tables, block_bytes=block_bytes).collect()}
    assert found == brute(docs, items)
    assert sum(n > 0 for _, n, _ in found.values()) > 20 and max(len(i) for *_, i in found.values()) > 2


def test_long_items_are_cut_into_segments_without_losing_a_window(spark, docs, items, tables, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 3)
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_overlaps(*tables, window=6).collect()}
    assert found == brute(docs, items, 6)


def test_colliding_hashes_are_told_apart(tables, docs, items, monkeypatch):
    """All windows of a size share three hashes: only the comparison of words decides."""
    real = decontamination.window_hashes
    monkeypatch.setattr(decontamination, "window_hashes", lambda *a: (lambda h, at: (h % np.uint64(3), at))(*real(*a)))
    segments = pa.table({"item": [str(i) for i, t in items if len(WORD.findall(t or "")) >= 10],
                         "size": pa.array([10] * sum(len(WORD.findall(t or "")) >= 10 for _, t in items), pa.int32()),
                         "text": [t for _, t in items if len(WORD.findall(t or "")) >= 10]})
    block = benchmark_block(segments)
    texts = pa.array([t or "" for _, t in docs])
    data, _, starts, ends, first = decontamination._words(texts)
    covered, at, found = decontamination._hits(block, data, starts, ends, first)
    expected = brute(docs, [(i, t) for i, t in items if len(WORD.findall(t or "")) >= 10])
    for k, (doc, _) in enumerate(docs):
        assert int(covered[first[k]:first[k + 1]].sum()) == expected[doc][1]
        assert [block.items[i] for i in found[at == k]] == expected[doc][2]


@pytest.mark.parametrize("block_bytes", [BLOCK_BYTES, 700])
def test_spans_and_documents_are_removed(tables, docs, items, block_bytes):
    df, benchmark = tables
    dirty = {d for d, (_, n, _) in brute(docs, items).items() if n}
    kept = decontaminate(df, benchmark, documents=True, block_bytes=block_bytes)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - dirty
    cut = decontaminate(df, benchmark, block_bytes=block_bytes)
    assert cut.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    runs = {r["doc_id"]: r["runs"] for r in find_overlaps(df, benchmark, block_bytes=block_bytes).collect()}
    for d, t in docs:
        if d not in dirty:
            assert texts[d] == t
            continue
        words = [(m.start(), m.end()) for m in WORD.finditer(t.translate(LOWER))]
        gone = [(r["start"], r["end"]) for r in runs[d]]
        assert gone == [(words[r["first_word"]][0], words[r["end_word"] - 1][1]) for r in runs[d]]
        assert texts[d] == "".join(t[a:b] for a, b in zip([0] + [e for _, e in gone], [s for s, _ in gone] + [len(t)]))


def test_rows_without_id_repeats_and_empty_tables(spark, tables, items):
    text = items[0][1]
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "clean words"), (6, None)], "doc_id bigint, text string")
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"]) for r in find_overlaps(docs, tables[1]).collect())
    n = len(WORD.findall(text))
    assert found == [(-1, n, n, ["0", "30"]), (5, 2, 0, []), (5, n, n, ["0", "30"]), (5, n, n, ["0", "30"]), (6, 0, 0, [])]
    kept = decontaminate(docs, tables[1], documents=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == [(5, "clean words")] and len(kept) == 2
    assert decontaminate(docs, tables[1]).where("text is null").count() == 1
    assert find_overlaps(docs.limit(0), tables[1]).count() == 0
    assert find_overlaps(docs, tables[1].limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    nameless = spark.createDataFrame([(None, text)], "item_id bigint, text string")
    unnamed = find_overlaps(docs.where("doc_id is null"), nameless).collect()
    assert [(r["n_hit"], r["items"]) for r in unnamed] == [(n, [])]


def test_the_query_has_digests_of_ids_as_text(spark):
    from tablewise.llm.queries import op11_decontamination

    rows = op11_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert {r["items_sha256"] for r in rows if not r["n_items"]} == {hashlib.sha256(b"").hexdigest()}
    assert any(r["contaminated"] for r in rows) and all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)


def test_runs_of_several_scans_merge():
    def run(a, b):
        return {"first_word": a, "end_word": b, "start": a * 10, "end": b * 10 - 1}

    assert merge_runs([run(5, 9), run(0, 3), run(8, 12), run(12, 14), run(20, 22), run(6, 7)]) == [
        run(0, 3), run(5, 14), run(20, 22)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=30), st.integers(0, 3))
def test_spans_are_compared_and_merged_exactly(words, bits):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    compare = Comparison(data)
    assert compare.equal(starts[i], ends[i], starts[j], ends[j]).tolist() == [words[a] == words[b] for a, b in zip(i, j)]
    hashes = np.array([hash(w) & ((1 << bits) - 1) for w in words], np.uint64)      # nearly all collide
    first = first_equal(hashes, lambda a, b: compare.equal(starts[a], ends[a], starts[b], ends[b]))
    assert first.tolist() == [words.index(w) for w in words]


def test_long_spans_and_the_hash_set():
    a = np.frombuffer(b"x" * 9000 + b"y" + b"x" * 9001, np.uint8)
    at = np.array
    assert Comparison(a).equal(at([0, 0, 0]), at([9000, 9001, 9000]), at([9001, 9001, 9002]), at([18001, 18002, 18002])).tolist() == [
        True, False, True]
    keys = np.array([5, 5 + 64, 5 + 128, 9, (1 << 64) - 1], np.uint64)      # the same place
    found = HashSet(keys).find(np.array([9, 5, 5 + 192, 5 + 128, 0, (1 << 64) - 1, 69], np.uint64))
    assert found.tolist() == [3, 0, -1, 2, -1, 4, 1]
    assert HashSet(np.zeros(0, np.uint64)).find(np.array([1], np.uint64)).tolist() == [-1]
