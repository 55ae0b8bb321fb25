"""Records with line breaks in quotes against the csv module, whatever blocks and batches a file is cut into."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewise import read_csv
from tablewise.sources import records
from tablewise.sources.records import OpenQuoteError, line_quotes, read_records
from tablewise.sources.tables import BrokenCsvError

TEXT = st.text(st.sampled_from('a,"\n'), max_size=60)
MARKS = ord(","), ord('"')


def walked(text: str) -> tuple[list[tuple[str, int]], bool]:
    """(records as text with their numbers of fields, does the text end inside quotes), by one state machine."""
    out, state, at, fields, start = [], "field", 0, 1, 0
    for i, c in enumerate(text):
        if state == "inside":
            state = "behind" if c == '"' else state
        elif c == '"' and (state == "field" or state == "behind" and text[i - 1] == '"'):
            state = "inside"
        elif c == ",":
            state, fields = "field", fields + 1
        elif c == "\n":
            out.append((text[start:i], fields))
            state, fields, start = "field", 1, i + 1
        else:
            state = "plain"
    if start < len(text):
        out.append((text[start:], fields))
    return out, state == "inside"


def cut(text: str, sizes: list[int]) -> tuple[list[tuple[str, int]], bool]:
    """The same through the maps of blocks of so many lines, batches of two lines."""
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
    blocks, at = [], 0
    for k in [*sizes, len(lines)]:
        if lines[at:at + k]:
            blocks.append(lines[at:at + k])
        at += k
    batches = [pa.record_batch([pa.array([1] * len(b)), pa.array([i] * len(b)), pa.array(b, pa.string())],
                               names=["file", "start", "value"]) for i, b in enumerate(blocks)]
    split = [x.slice(k, 2) for x in batches for k in range(0, len(x), 2)]
    maps = next(records._block_maps(*MARKS)(iter(split))).to_pylist()
    inside, states = False, []
    for m in sorted(maps, key=lambda m: m["start"]):
        states.append(inside)
        inside = bool(m["from_inside"] if inside else m["from_outside"])
    if inside:
        return [], True
    marked = [x.append_column("inside", pa.array([states[x.column("start")[0].as_py()]] * len(x))) for x in split]
    found = [r for b in records._cut(*MARKS)(iter(marked)) for r in b.to_pylist()]
    out, open_ = [], None
    for r in found:
        if r["part"] == records._WHOLE:
            out.append((r["value"], r["delimiters"] + 1))
        elif r["part"] == records._BEGINNING:
            open_ = [r["value"], r["delimiters"]]
        else:
            open_ = [open_[0] + r["value"], open_[1] + r["delimiters"]]
            if r["part"] == records._END:
                out.append((open_[0], open_[1] + 1))
    assert sum(r["first"] for r in found) <= 1
    return out, False


@settings(max_examples=600, deadline=None)
@given(TEXT, st.lists(st.integers(1, 4), max_size=6))
def test_any_blocks_give_the_records_of_one_walk(text, sizes):
    expected, open_ = walked(text)
    found, ours_open = cut(text, sizes)
    assert ours_open == open_
    if not open_:
        assert [r for r in found if r[0]] == [r for r in expected if r[0]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from('a,"\n'), max_size=6), min_size=2, max_size=4), min_size=1, max_size=8))
def test_written_tables_come_back(rows):
    file = io.StringIO()
    csv.writer(file, lineterminator="\n").writerows(rows)
    expected, _ = walked(file.getvalue())
    assert [next(csv.reader([t + "\n"])) if "\n" not in t else next(csv.reader(io.StringIO(t))) for t, _ in expected] == rows
    assert [n for _, n in expected] == [len(r) for r in rows]


def test_prefixes_are_compositions():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 27, 301).astype(np.uint8)
    state, ends = np.arange(3), []
    for m in maps:
        state = records._MAPS[m][state]
        ends.append(state)
    assert (records._MAPS[records.prefixes(maps)] == np.array(ends)).all()
    assert (records._MAPS[records.composed(maps)] == ends[-1]).all() and records.composed(maps[:0]) == records._IDENTITY


def test_lines_as_expressions(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('ab,"') for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    open_, n = line_quotes(F.col("value"))
    for r in rows.select("value", open_.alias("open"), n.alias("n")).collect():
        expected, ends_open = walked(r["value"])
        assert (r["open"], r["n"]) == (ends_open, expected[0][1] if expected else 1), r["value"]


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(k) for k in key]
    spark.conf.set(key[0], "300")
    spark.conf.set(key[1], "0")
    yield
    for k, v in zip(key, before):
        spark.conf.set(k, v)


def test_a_file_of_many_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(9)
    folder = tmp_path / "f"
    folder.mkdir()
    rows = []
    for f in range(3):
        own = [(f"{f}-{i}", "".join(rng.choice('ab ,"\nß') for _ in range(rng.choice([0, 5, 40, 900]))), str(i)) for i in range(120)]
        with (folder / f"{f}.csv").open("w", newline="") as out:
            writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
            writer.writerow(["id", "the\nnote", "n"])
            writer.writerows(own)
        rows += own
    found = read_records(spark, str(folder))
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    assert found.where("first").count() == 3 and found.agg(F.max("n_fields"), F.min("n_fields")).first()[:] == (3, 3)
    df = read_csv(spark, str(folder), multi_line=True)
    assert df.columns == ["id", "the\nnote", "n"] and df.dtypes[2][1] == "bigint"
    assert sorted((r[0], r[1] or "", r[2]) for r in df.collect()) == sorted((a, b, int(c)) for a, b, c in rows)


def test_what_is_refused(spark, tmp_path):
    def read(text, **how):
        (tmp_path / "a.csv").write_text(text)
        spark.catalog.refreshByPath(str(tmp_path))
        return [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), **how).collect()]

    assert read('a,b\n1,5" pipe\n2,"x"\n') == [(1, '5" pipe'), (2, "x")]
    assert read('a,b\n1,5" pipe\n2,"x\ny"\n', multi_line=True) == [(1, '5" pipe'), (2, "x\ny")]
    for text in ("a,b\n3,4,\n", 'a,b\n3,"4,5",\n'):
        for how in ({}, {"multi_line": True}):
            with pytest.raises(BrokenCsvError, match="more than the 2 fields"):
                read(text, **how)
    with pytest.raises(BrokenCsvError, match="not closed"):
        read('a,b\n1,"x\n2,y\n', multi_line=True)
    with pytest.raises(OpenQuoteError):
        read_records(spark, str(tmp_path / "a.csv"))
    assert read("a,b\n1,2\na,b\n3,4\n") == [("1", "2"), ("a", "b"), ("3", "4")]     # a header among the rows
    assert read("a,b\n1,2\na,b\n3,4\n", multi_line=True) == [("1", "2"), ("a", "b"), ("3", "4")]
    assert read("a;b\n1;'x;\ny'\n", multi_line=True, sep=";", quote="'", escape="'") == [(1, "x;\ny")]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n1,2\n")
    for how in ({}, {"multi_line": True}):
        with pytest.raises(BrokenCsvError, match="header"):
            read_csv(spark, str(folder), **how)
