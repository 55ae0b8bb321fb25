"""Records of delimited text whose quotes may hold line breaks, read by as many tasks as the files have blocks.

Whether a line break ends a record depends on every quote before it, so a block in the middle of a file cannot be cut by
itself. But there are three states only: outside quotes, inside, and behind a quote inside that may close the field or be
the first of a doubled one. Every quote maps states to states, a block maps its first state to its last, and a prefix
composition of the blocks' maps says in which state each block begins. Then every block is cut by its own task, and only
the records that cross a block's end are put together in a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.sources.staging import stage

_OUTSIDE, _INSIDE, _BEHIND = 0, 1, 2
#: What a quote does to the states: next to another quote, at the start of a field, elsewhere
_NEXT_TO_QUOTE, _OPENING, _STRAY = (0, 2, 1), (1, 2, 1), (0, 2, 0)

_MAPS = np.array([(a, b, c) for a in range(3) for b in range(3) for c in range(3)], np.uint8)
_IDENTITY = 9 * 0 + 3 * 1 + 2


def _number(mapping: tuple[int, int, int]) -> int:
    return 9 * mapping[0] + 3 * mapping[1] + mapping[2]


#: _THEN[27 * f + g] is the map "first f, then g"
_THEN = np.array([_number(tuple(_MAPS[g][_MAPS[f]])) for f in range(27) for g in range(27)], np.uint8)


def quote_maps(data: np.ndarray, at: np.ndarray, delimiter: int, quote: int) -> np.ndarray:
    """The map of each quote data[at[i]], by the byte before it. ``data`` begins with a line."""
    before = np.where(at > 0, data[at - 1], ord("\n"))
    return np.select([before == quote, (before == delimiter) | (before == ord("\n"))],
                     [_number(_NEXT_TO_QUOTE), _number(_OPENING)], _number(_STRAY)).astype(np.uint8)


def composed(maps: np.ndarray) -> int:
    """All maps one after the other: neighbours are composed until one is left."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        pairs = maps[:len(maps) // 2 * 2].astype(np.int64)
        maps = np.concatenate([_THEN[27 * pairs[::2] + pairs[1::2]], odd])
    return int(maps[0]) if len(maps) else _IDENTITY


def prefixes(maps: np.ndarray) -> np.ndarray:
    """Map i composed with all before it, by doubling distances."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = _THEN[27 * out[:-step].astype(np.int64) + out[step:]]
        step *= 2
    return out


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all lines with a line break behind each, positions of these line breaks)."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    values = column.buffers()[2]
    text = np.frombuffer(values, np.uint8)[bounds[0]:bounds[-1]] if values is not None and len(column) else np.zeros(0, np.uint8)
    breaks = bounds[1:] - bounds[0] + np.arange(len(column))
    data = np.empty(len(text) + len(column), np.uint8)
    own = np.ones(len(data), bool)
    own[breaks] = False
    data[breaks], data[own] = ord("\n"), text
    return data, breaks


def _blocks(rows: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The rows of each block of a file."""
    if not len(rows):
        return
    keys = np.stack([rows.column("file").to_numpy(), rows.column("start").to_numpy()])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        yield (int(keys[0, a]), int(keys[1, a])), rows.slice(a, b - a)


def _block_maps(delimiter: int, quote: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for rows in batches:
            for key, part in _blocks(rows):
                data, _ = _joined(part.column("value"))
                maps = quote_maps(data, np.flatnonzero(data == quote), delimiter, quote)
                found[key] = int(_THEN[27 * found.get(key, _IDENTITY) + composed(maps)])
        ends = [[int(_MAPS[m][s] == _INSIDE) for m in found.values()] for s in (_OUTSIDE, _INSIDE)]
        yield pa.record_batch([pa.array([k[i] for k in found], pa.int64()) for i in range(2)]
                              + [pa.array(e, pa.int32()) for e in ends], names=["file", "start", "from_outside", "from_inside"])

    return scan


#: ``part`` of a row: a record, or of a record that crosses blocks its end, its beginning, a block without an end
_WHOLE, _END, _BEGINNING, _MIDDLE = 0, 1, 2, 3
RECORDS = "file bigint, start bigint, part int, first boolean, delimiters bigint, value string"


class _Cutter:
    """Cuts the lines of one block into records."""

    def __init__(self, key: tuple[int, int], inside: bool, delimiter: int, quote: int):
        self.file, self.start = key
        self.delimiter, self.quote = delimiter, quote
        self.state = _INSIDE if inside else _OUTSIDE
        self.continued = inside             # the record before is still open
        self.first = self.start == 0        # no record of the file has been seen
        self.waiting, self.waiting_delimiters = b"", 0

    def _row(self, part: int, text: bytes, delimiters: int) -> tuple:
        first, self.first = self.first, self.first and not text.strip()
        return self.file, self.start, part, first and not self.first, delimiters, text.decode("utf-8", "replace")

    def lines(self, column: pa.Array) -> list[tuple]:
        data, breaks = _joined(column)
        quotes = np.flatnonzero(data == self.quote)
        after = _MAPS[prefixes(quote_maps(data, quotes, self.delimiter, self.quote)), self.state]
        states = np.concatenate([[self.state], after])
        ends = breaks[states[np.searchsorted(quotes, breaks)] != _INSIDE]
        split = np.flatnonzero(data == self.delimiter)
        split = split[states[np.searchsorted(quotes, split)] != _INSIDE]
        counts = np.diff(np.searchsorted(split, ends), prepend=0).tolist()
        raw, out, at = data.tobytes(), [], 0
        for end, n in zip(ends.tolist(), counts):
            part = _END if self.continued else _WHOLE
            out.append(self._row(part, self.waiting + raw[at:end].removesuffix(b"\r"), self.waiting_delimiters + n))
            self.continued, self.waiting, self.waiting_delimiters, at = False, b"", 0, end + 1
        if at < len(raw):
            self.waiting += raw[at:]
            self.waiting_delimiters += len(split) - sum(counts)
        if len(breaks):
            self.state = _INSIDE if at < len(raw) else _OUTSIDE
        return out

    def rest(self) -> list[tuple]:
        if self.state != _INSIDE:
            return []
        return [self._row(_MIDDLE if self.continued else _BEGINNING, self.waiting, self.waiting_delimiters)]


def _cut(delimiter: int, quote: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Cutter | None = None
        for rows in batches:
            for key, part in _blocks(rows):
                if open_ is None or (open_.file, open_.start) != key:
                    if open_:
                        yield table(open_.rest())
                    open_ = _Cutter(key, bool(part.column("inside")[0].as_py()), delimiter, quote)
                yield table(open_.lines(part.column("value")))
        if open_:
            yield table(open_.rest())

    return cut


class OpenQuoteError(ValueError):
    """A file ends inside quotes."""


def read_records(spark: SparkSession, path: str | list[str], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """(first, n_fields, value): the records of delimited text files, each one text; ``first`` is that of its file.

    A quote opens a field only at the field's start, a quote inside may be doubled, any other quote is a character. Files
    are read twice, by blocks: for the states, and to be cut. The records are written to the shared folder. Blank lines
    are no records. A file that ends inside quotes raises.
    """
    marks = ord(delimiter), ord(quote)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    maps = lines.mapInArrow(_block_maps(*marks), "file bigint, start bigint, from_outside int, from_inside int")
    blocks = F.sort_array(F.collect_list(F.struct("start", "from_outside", "from_inside"))).alias("blocks")
    # one row for each file, with a few numbers for each block: the state behind all blocks up to each
    ends = F.expr("""aggregate(blocks, cast(array() as array<int>), (s, b) -> concat(s, array(
        if(size(s) > 0 and s[size(s) - 1] = 1, b.from_inside, b.from_outside))))""")
    states = stage(maps.groupBy("file").agg(blocks).select("file", "blocks", ends.alias("ends")), "csv-states")
    if not states.where("element_at(ends, -1) = 1").isEmpty():
        raise OpenQuoteError(f"a quote is not closed before the end of a file of {path}")
    begin = states.select("file", F.posexplode("ends").alias("i", "end"), "blocks").where(
        "end = 1").select("file", F.expr("blocks[i + 1].start").alias("start"), F.lit(True).alias("inside"))
    inside = stage(begin, "csv-inside")
    # as many rows as blocks that begin inside quotes; the blocks of a file are some bytes each in the table above
    marked = lines.join(F.broadcast(inside), ["file", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    parts = stage(marked.select("file", "start", "inside", "value").mapInArrow(_cut(*marks), RECORDS), "csv-records")
    whole = parts.where(F.col("part") == _WHOLE).select("first", "delimiters", "value")
    return whole.union(_put_together(parts.where(F.col("part") != _WHOLE))).where("trim(value) <> ''").select(
        "first", (F.col("delimiters") + 1).alias("n_fields"), "value")


def _put_together(parts: DataFrame) -> DataFrame:
    """The records that cross the end of a block: at most two pieces of each block are here."""
    order = Window.partitionBy("file").orderBy("start", "part")
    numbered = parts.withColumn("record", F.sum((F.col("part") == _BEGINNING).cast("bigint")).over(order))
    whole = numbered.groupBy("file", "record").agg(
        F.max("first").alias("first"), F.sum("delimiters").alias("delimiters"),
        F.sort_array(F.collect_list(F.struct("start", "part", "value"))).alias("pieces"))
    return whole.select("first", "delimiters", F.array_join("pieces.value", "").alias("value"))


def line_quotes(line: Column, delimiter: str = ",", quote: str = '"') -> tuple[Column, Column]:
    """(does a line that begins outside quotes end inside them, its number of fields), by the same rules, as expressions.

    A line without quotes is counted by its delimiters; the texts between quotes of the others are walked through.
    """
    def count(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(delimiter)))

    def step(state: Column, text: Column) -> Column:
        """From the state behind a quote over the text after it to the state behind the next quote."""
        opens = text.endswith(delimiter) | ((text == "") & (state["s"] == _BEHIND))
        after = F.when(state["s"] == _INSIDE, _BEHIND).when(opens, _INSIDE).otherwise(_OUTSIDE)
        return F.struct(after.alias("s"), (state["n"] + F.when(state["s"] != _INSIDE, count(text)).otherwise(0)).alias("n"))

    texts = F.split(line, "\\Q" + quote + "\\E", -1)
    first, last = F.element_at(texts, 1), F.element_at(texts, -1)
    start = F.struct(F.when((first == "") | first.endswith(delimiter), _INSIDE).otherwise(_OUTSIDE).alias("s"),
                     count(first).alias("n"))
    end = F.aggregate(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 2, F.lit(0))), start, step)
    quoted = line.contains(quote)
    fields = F.when(quoted, end["n"] + F.when(end["s"] != _INSIDE, count(last)).otherwise(0)).otherwise(count(line))
    # a condition, not a conjunction: Spark may evaluate what is shared inside a conjunction for every line
    return F.when(quoted, end["s"] == _INSIDE).otherwise(False), fields + 1
