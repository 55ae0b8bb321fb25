"""The audit of filters against brute force: every order applied to every document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewise.llm.filter_audit import FILTERS, MEASURES, Transducer, audit_filters, count_texts, verdicts
from tablewise.llm.grams import layout

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, part string, mask int, least_id bigint, n_words string"


def fails(text, repeats):
    words = WORD.findall(text)
    return {f for f, yes in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                                          100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                                          bool(re.search(r"[#$%&*|]", text)), repeats)) if yes}


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    facts = [(part or "", fails(t or "", d is not None and d > first[t or ""]), (labels.get(d) or (0, 0)) if d is not None else (0, 0))
             for d, t, part in docs]
    out = {}
    for part in {p for p, *_ in facts}:
        mine, shapley = [x for x in facts if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] and bool(x[1] & set(order[:step - 1])) for x in mine),
                    sum(x[1] == {f} for x in mine), sum(x[2][0] for x in gone), sum(x[2][1] for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


@pytest.fixture(scope="module")
def docs():
    plain = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", plain, plain, plain + " #", "a " * 300, "A " * 300, "a b c", "é" * 300, "日本 " * 210, plain.upper(),
             plain + " end", " \t\n", "a&b", plain, "", None, "x" * 20_000, plain + " " + plain, plain + " A" * 40]
    return [(i * 3 % 41, t, [None, "s1", "s2", ""][i % 4]) for i, t in enumerate(texts)] + [
        (None, plain, "s1"), (None, plain, "s1"), (2, plain, "s2"), (2, plain, "s2")]


LABELS = {0: (1, 0), 3: (0, 1), 9: (1, 1), 12: (0, 0), 2: (1, 0)}


def frames(spark, docs):
    labels = [(k, q, t) for k, (q, t) in LABELS.items()] + [(9, None, 0), (None, 1, 1), (777, 1, 1)]
    return (spark.createDataFrame([(d, t, s, "x", 1, 2, "y") for d, t, s in docs], SCHEMA),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_all_orders(spark, docs):
    found = audit_filters(*frames(spark, docs)).collect()
    ours = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in MEASURES] for r in found}
    assert len(found) == len(ours) and ours == brute(docs, LABELS)


def test_a_third_of_the_table_is_one_text(spark):
    docs = [(i, "the same text" if i % 3 == 0 else f"text {i}", f"s{i % 2}") for i in range(600)]
    found = audit_filters(*frames(spark, docs)).where("filter_order = 'EABCD'").collect()
    expected = brute(docs, LABELS)
    assert {(r["part"], r["step"]): r["removed"] for r in found} == {
        (p, s): v[1] for (p, o, s), v in expected.items() if o == "EABCD"}
    assert sum(r["removed"] for r in found if r["step"] == 1) == 199


def test_other_filters_and_empty_tables(spark, docs):
    df, labels = frames(spark, docs)
    two = {"X": lambda: F.col("n_chars") == 0, "Y": FILTERS["E"]}
    rows = audit_filters(df, labels, two).where("part = 's1'").collect()
    assert {r["filter_order"] for r in rows} == {"XY", "YX"} and len(rows) == 4
    assert audit_filters(df.limit(0), labels).collect() == []
    assert {r["good_lost"] for r in audit_filters(df, labels.limit(0)).collect()} == {0}
    masks = verdicts(count_texts(df)).where("doc_id is null").select("mask").distinct().collect()
    assert [r["mask"] & 16 for r in masks] == [0]       # a document without an id repeats nothing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tabAB#|é日𝔸\x00\x1f"), max_size=40), max_size=8))
def test_the_transducer_counts_as_regular_expressions_do(texts):
    data, bounds = layout(pa.array(texts, pa.string()))
    found = Transducer.of().run(data, bounds)
    words = [WORD.findall(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(w) for w in words]
    assert found.distinct_words().tolist() == [len(set(w)) for w in words]
    assert found.capitals.tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
    assert found.points.tolist() == [len(t) for t in texts]
    assert found.symbols.tolist() == [len(re.findall(r"[#$%&*|]", t)) for t in texts]
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(found.starts, found.ends)] == [w for ws in words for w in ws]


def test_words_of_any_length():
    texts = ["x" * 100_000 + " " + "x" * 100_000, "x" * 100_000 + " " + "x" * 99_999 + "y", "a" * 8 + " " + "a" * 9 + " " + "a" * 8]
    data, bounds = layout(pa.array(texts))
    assert Transducer.of().run(data, bounds).distinct_words().tolist() == [1, 2, 2]
