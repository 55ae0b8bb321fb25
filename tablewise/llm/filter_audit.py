"""How filters of documents interact: what each removes in every order, alone, twice over, and of what is worth keeping.

One pass over the bytes of a text, by a table of (state, byte), counts its words, capitals, code points and symbols and
finds its words, which go into a hash table that compares before it merges. A filter's verdicts are bits of a mask, and
all orders are sums over the number of documents of each mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import claim_worker, rows_of, small, with_text
from tablewise.llm.grams import hash_spans, layout, mix
from tablewise.llm.spans import Comparison, first_equal
from tablewise.sources.staging import stage

#: Fixed values
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#$%&*|"

# what a byte says in a state
_START, _END, _CAPITAL, _POINT, _SYMBOL = 1, 2, 4, 8, 16
_OUTSIDE, _INSIDE = 0, 1


@dataclass(frozen=True)
class Transducer:
    """A finite-state machine over UTF-8 with the states outside and inside a word.

    ``next_state`` has the state after a byte. It is the same from both states, so that the states of all positions
    are one look-up; ``says[state, byte]`` has what the step says: a word starts, a word has ended, a capital, a code point
    (any byte but a continuation), a symbol.
    """

    next_state: np.ndarray
    says: np.ndarray

    @classmethod
    def of(cls, spaces: bytes = SPACES, symbols: bytes = SYMBOLS) -> Transducer:
        next_state = np.full(256, _INSIDE, np.uint8)
        next_state[list(spaces)] = _OUTSIDE
        says = np.zeros((2, 256), np.uint8)
        says[:, 0x41:0x5B] |= _CAPITAL
        says[:, :0x80] |= _POINT
        says[:, 0xC0:] |= _POINT
        says[:, list(symbols)] |= _SYMBOL
        says[_OUTSIDE, next_state == _INSIDE] |= _START
        says[_INSIDE, next_state == _OUTSIDE] |= _END
        return cls(next_state, says)

    def run(self, data: np.ndarray, bounds: np.ndarray) -> TextCounts:
        """Over the texts data[bounds[i]:bounds[i + 1]], each from the state outside."""
        after = self.next_state[data]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        texts = np.flatnonzero(np.diff(bounds))
        before[bounds[texts]] = _OUTSIDE
        said = self.says[before, data]
        last = bounds[texts + 1]
        starts = np.flatnonzero(said & _START)
        ends = np.sort(np.concatenate([np.flatnonzero(said & _END), last[after[last - 1] == _INSIDE]]))

        def count(what: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum((said & what) != 0)])
            return total[bounds[1:]] - total[bounds[:-1]]

        return TextCounts(data, starts, ends, np.searchsorted(starts, bounds), count(_CAPITAL), count(_POINT), count(_SYMBOL))


@dataclass
class TextCounts:
    """Counts of each text, and its words data[starts[j]:ends[j]] for j from first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray

    def distinct_words(self) -> np.ndarray:
        """Distinct words of each text: the words that found no equal one in the hash table."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        hashes = mix(hash_spans(self.data, self.starts, self.ends) ^ mix(text.astype(np.uint64) + np.uint64(1)))
        compare = Comparison(self.data)

        def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = text[i] == text[j]
            at = np.flatnonzero(out)
            i, j = i[at], j[at]
            out[at] = compare.equal(self.starts[i], self.ends[i], self.starts[j], self.ends[j])
            return out

        new = first_equal(hashes, same) == np.arange(len(text))
        total = np.concatenate([[0], np.cumsum(new)])
        return total[self.first[1:]] - total[self.first[:-1]]


COUNTS = "n_words bigint, n_distinct bigint, n_capitals bigint, n_chars bigint, n_symbols bigint, text_digest binary"


def _counted(symbols: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("filter_audit")
        machine = Transducer.of(symbols=symbols)
        for rows in rows_of(batches):
            data, bounds = layout(rows.column("text"))
            found, raw = machine.run(data, bounds), data.tobytes()
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch(
                [rows.column("doc_id"), rows.column("part"),
                 *(pa.array(x, pa.int64()) for x in (np.diff(found.first), found.distinct_words(), found.capitals,
                                                     found.points, found.symbols)), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols", "text_digest"])

    return count


def count_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                symbols: bytes = SYMBOLS) -> DataFrame:
    """One row per document: doc_id, part, n_words, n_distinct, n_capitals, n_chars, n_symbols, text_digest (128 bits).

    Words are runs of anything but ASCII white space; n_distinct tells upper and lower case apart; capitals are A to Z.
    A missing text is empty, a missing part the empty text. One scan, no shuffle.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    docs = with_text(df.select(F.col(id_col).cast("bigint").alias(id_col), text_col, part), id_col, text_col, "part")
    return docs.mapInArrow(_counted(symbols), f"doc_id bigint, part string, {COUNTS}")


#: Failure conditions over the columns of ``count_texts``; ``repeats`` is true for a text that a smaller id has, too.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_capitals") > 2 * F.col("n_chars"),
    "D": lambda: F.col("n_symbols") > 0,
    "E": lambda: F.col("repeats"),
}


@dataclass(frozen=True)
class Orders:
    """All orders of ``n`` filters over all masks of failures, as matrices of one row for each order and step."""

    n: int
    steps: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def matrices(self) -> dict[str, np.ndarray]:
        masks = np.arange(1 << self.n)
        fails = (masks[:, None] >> np.arange(self.n)) & 1
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
        for order in permutations(range(self.n)):
            gone = np.zeros(len(masks), bool)
            for step, f in enumerate(order, 1):
                mine = fails[:, f] == 1
                out["removed"].append(mine & ~gone)
                out["redundant"].append(mine & gone)
                out["unique_fails"].append(masks == 1 << f)
                gone = gone | mine
                out["kept"].append(~gone)
                self.steps.append((order, step))
        return {k: np.array(v, np.int64).reshape(-1, len(masks)) for k, v in out.items()}


@cache
def _orders(n: int) -> tuple[Orders, dict[str, np.ndarray]]:
    orders = Orders(n)
    return orders, orders.matrices()


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audited(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, by_mask = _orders(len(names))
        letter = np.array([order[step - 1] for order, step in orders.steps])
        texts = pa.array(["".join(names[f] for f in order) for order, _ in orders.steps])
        steps = pa.array([step for _, step in orders.steps], pa.int32())
        for rows in batches:
            for part, cells in zip(rows.column("part").to_pylist(), rows.column("cells").to_pylist()):
                n, good, toxic = np.zeros((3, 1 << len(names)), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = {k: m @ n for k, m in by_mask.items()}
                out["good_lost"], out["toxic_lost"] = by_mask["removed"] @ good, by_mask["removed"] @ toxic
                total = np.zeros(len(names), np.int64)
                np.add.at(total, letter, out["removed"])
                out["shapley"] = total[letter]
                yield pa.record_batch([pa.array([part] * len(steps), pa.string()), texts, steps,
                                       *(pa.array(out[m], pa.int64()) for m in MEASURES)],
                                      names=["part", "filter_order", "step", *MEASURES])

    return audit


def verdicts(counts: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """(doc_id, part, mask) of documents counted by ``count_texts``: bit i is set if the document fails filter i.

    A text repeats if the same text has a smaller id in the whole table. The least id of each repeated text is found by
    an aggregate that is taken in every task first; the join with it is broadcast while the repeated texts are few, and
    beyond that a join of narrow rows whose hot texts Spark splits. A document without an id repeats nothing.
    """
    least = counts.groupBy("text_digest").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    repeated = stage(least.where("copies > 1").select("text_digest", "least_id"), "audit-repeated-texts")
    known = counts.join(small(repeated), "text_digest", "left").withColumn(
        "repeats", F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False)))
    mask = sum((F.when(fails(), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    return known.select("doc_id", "part", mask.alias("mask"))


def audit_filters(df: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column]] = FILTERS,
                  id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                  symbols: bytes = SYMBOLS) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, and counts of documents of the part:
    kept after the step, removed by it, redundant (failing its filter, removed before), unique_fails (failing its filter
    alone), good_lost and toxic_lost (removed by it, label quality or toxic is 1), shapley (removed by its filter, summed
    over all orders).

    ``filters`` maps one letter to a condition of failure over the columns of ``count_texts`` and ``repeats``. Every filter
    judges every document once; the n! orders are sums over the 2^n masks, taken from one row per part.

    Defined results: a missing text is empty; a missing part is the part ''; a document without an id has no label and
    repeats nothing; rows of one id are documents of their own, with the labels of that id (1 if any label row of the id
    says 1); texts are judged over the whole table, across parts; an empty table gives no rows.
    """
    counts = stage(count_texts(df, id_col, text_col, part_col, symbols), "audit-counts")
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("good + toxic > 0")
    judged = verdicts(counts, filters).join(small(stage(marks, "audit-labels")), "doc_id", "left")
    cells = judged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return by_part.mapInArrow(_audited(list(filters)), "part string, filter_order string, step int, "
                              + ", ".join(f"{m} bigint" for m in MEASURES))
