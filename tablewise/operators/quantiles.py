"""Exact quantiles with linear interpolation, for columns of any length.

Spark's ``percentile`` ends in one task that holds a value -> count map per column. It is used only up to
``direct_rows`` values. Beyond it the wanted order statistics are searched for:

1. a sketch of some of the rows proposes two ends around each wanted rank,
2. one aggregate over all rows counts the values below and up to each end, which gives the exact ranks of
   the ends: a wanted rank may be an end itself, lie between the ends, or have been missed, in which case
   that side stays open and the next sketch is taken wider,
3. brackets with more than ``budget`` rows between their ends go back to step 1, on their inside only; one that
   the sketch did not narrow is halved by value,
4. the rows inside the other brackets, known to be few, are sorted and picked from.

Every step is a partially aggregated scan of the wanted columns; only counts and ends reach the driver.
The sketch steers the search but never enters the result. A value that fills a third of the table ends up
as an end of a bracket, so its rows are counted and never collected.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tablewise.constants import (
    AGGREGATES_PER_PASS,
    DIRECT_QUANTILE_ROWS,
    PICK_ROWS_PER_PASS,
    QUANTILE_BUDGET_ROWS,
    SKETCH_ACCURACY,
    SKETCH_MAX_ROWS,
    SKETCH_ROWS,
)
from tablewise.operators.roles import column

_SEED = 7


def statistic_column(df: DataFrame, name: str) -> Column:
    """The column as its statistics see it: integers as they are, all other numbers as DOUBLE."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return column(name)
    return column(name).cast("double")


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def aggregate_row(df: DataFrame, aggregates: list[str] | list[Column]) -> list:
    """Values of many aggregates (SQL texts or columns), split so that every pass gets generated code."""
    values: list = []
    for part in chunks(aggregates, AGGREGATES_PER_PASS):
        if isinstance(part[0], str):
            row = df.selectExpr(*[f"{a} as a{i}" for i, a in enumerate(part)])
        else:
            row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(part)])
        values.extend(row.first())
    return values


def sql_number(value) -> str:
    """A literal of the same value: integers as BIGINT, the rest as DOUBLE."""
    if isinstance(value, int):
        return f"{value}L"
    return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"


def sql_array(values: list) -> str:
    return f"array({', '.join(sql_number(v) for v in values)})"


def interpolate(low: float, high: float, at: float) -> float:
    """Between the values at the ranks around ``at``, by the formula of Spark's ``percentile``, bit for bit."""
    if low == high or at == math.floor(at):
        return low
    return (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def midpoint(low, high):
    """A value from ``low`` on and below ``high``, half way: integers by value, doubles by their order as bits, so that
    64 steps part any two."""
    if isinstance(low, int) and isinstance(high, int):
        return (low + high) // 2
    bits = [struct.unpack("<q", struct.pack("<d", float(v)))[0] for v in (low, high)]
    places = [b if b >= 0 else -(b & (1 << 63) - 1) for b in bits]     # ascending with the value
    middle = sum(places) // 2
    return struct.unpack("<d", struct.pack("<q", middle if middle >= 0 else -middle - (1 << 63)))[0]


@dataclass
class _Search:
    """Order statistics ``ranks`` (from 0) of one column, all strictly between ``low`` and ``high``."""

    name: str
    col: str
    ranks: list[int]
    upto: int                      # rank of the first value above ``low``
    until: int                     # rank of the first value that is not below ``high``
    low: object = None             # None: open
    high: object = None
    slack: int = 1
    found: dict = field(default_factory=dict)   # rank -> value
    stuck: bool = False            # the last sketch brought nothing: halve the bracket instead
    parted: bool = False           # its ranks are searched for one by one

    @property
    def rows(self) -> int:
        return self.until - self.upto

    @property
    def open_ranks(self) -> list[int]:
        return [] if self.parted else [r for r in self.ranks if r not in self.found]

    def part(self) -> list[_Search]:
        """A search for each rank, from the same bracket on, that puts what it finds here."""
        parts = [replace(self, ranks=[r]) for r in self.open_ranks]
        self.parted = True
        return parts

    def inside(self) -> str:
        ends = []
        if self.low is not None:
            ends.append(f"{self.col} > {sql_number(self.low)}")
        if self.high is not None:
            ends.append(f"{self.col} < {sql_number(self.high)}")
        return f"case when {' and '.join(ends)} then {self.col} end" if ends else self.col

    def around(self, fraction: float) -> list[float]:
        """Two probabilities, relative to the inside, far enough from the wanted ranks to hold them."""
        sampling = 2 * math.sqrt(self.rows / fraction) if fraction < 1 else 0
        margin = self.slack * (sampling + 2 * self.rows / SKETCH_ACCURACY + 2)
        first = min(self.open_ranks) - self.upto - margin
        last = max(self.open_ranks) - self.upto + margin
        return [min(1.0, max(0.0, x / max(1, self.rows - 1))) for x in (first, last)]

    def narrow(self, low, high, below: dict, upto: dict) -> None:
        """Take new ends, given for each end how many values of the column lie below and up to it."""
        before = len(self.open_ranks), self.upto, self.until
        self._take(low, high, below, upto)
        self.stuck = (len(self.open_ranks), self.upto, self.until) == before

    def _take(self, low, high, below: dict, upto: dict) -> None:
        if low is None or high is None:
            self.slack *= 8
            return
        for rank in self.open_ranks:
            for end in (low, high):
                if below[end] <= rank < upto[end]:
                    self.found[rank] = end
        left = self.open_ranks
        if not left:
            return
        if any(r < below[low] for r in left) or any(r >= upto[high] for r in left):
            self.slack *= 8
        for end in (low, high):
            if all(r >= upto[end] for r in left) and upto[end] > self.upto:
                self.low, self.upto = end, upto[end]
            if all(r < below[end] for r in left) and below[end] < self.until:
                self.high, self.until = end, below[end]


def _propose(df: DataFrame, searches: list[_Search]) -> list[tuple]:
    """Sketched ends for each search. Searches in the same bracket share one sketch."""
    fewest = min(s.rows for s in searches)
    fraction = min(1.0, min(max(SKETCH_ROWS, fewest // 1000), SKETCH_MAX_ROWS) / fewest)
    rows = df.sample(fraction, _SEED) if fraction < 1 else df
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.name, s.low, s.high), []).append(s)
    sketches = aggregate_row(rows, [
        f"percentile_approx({group[0].inside()}, "
        f"{sql_array([p for s in group for p in s.around(fraction)])}, {SKETCH_ACCURACY})"
        for group in shared.values()
    ])
    ends = {}
    for group, points in zip(shared.values(), sketches):
        for s, pair in zip(group, chunks(points or [None, None] * len(group), 2)):
            ends[id(s)] = tuple(pair)
    return [ends[id(s)] for s in searches]


def _count_around(df: DataFrame, searches: list[_Search], ends: list[tuple]) -> dict:
    """(name, end) -> (values below, values up to) for every distinct end."""
    points = {(s.name, e): s.col for s, pair in zip(searches, ends) for e in pair if e is not None}
    counts = aggregate_row(df, [
        f"count_if({col} {op} {sql_number(e)})" for (_, e), col in points.items() for op in ("<", "<=")
    ])
    return dict(zip(points, chunks(counts, 2)))


def _halve(df: DataFrame, searches: list[_Search]) -> list[tuple]:
    """The middle between the least and the largest value inside each bracket, as both ends."""
    found = aggregate_row(df, [f"{f}({s.inside()})" for s in searches for f in ("min", "max")])
    return [(midpoint(low, high),) * 2 for low, high in chunks(found, 2)]


def _narrow_all(df: DataFrame, searches: list[_Search], budget: int) -> None:
    """Narrow every bracket to ``budget`` rows. A sketch works in doubles and may propose the same ends for ever,
    where many rows have one value beyond 2^53; then the bracket is halved, at most 64 times for each rank."""
    wide = [s for s in searches if s.open_ranks and s.rows > budget]
    while wide:
        for s in [s for s in wide if s.stuck and len(s.open_ranks) > 1]:
            searches += s.part()
        wide = [s for s in searches if s.open_ranks and s.rows > budget]
        halved = [s for s in wide if s.stuck]
        sketched = [s for s in wide if not s.stuck]
        wide = halved + sketched
        ends = (_halve(df, halved) if halved else []) + (_propose(df, sketched) if sketched else [])
        counts = _count_around(df, wide, ends)
        for s, (low, high) in zip(wide, ends):
            known = {e: counts[s.name, e] for e in (low, high) if e is not None}
            s.narrow(low, high, {e: c[0] for e, c in known.items()}, {e: c[1] for e, c in known.items()})
        wide = [s for s in searches if s.open_ranks and s.rows > budget]


def _pick_all(df: DataFrame, searches: list[_Search], budget: int) -> None:
    """Sort what is left inside the brackets and take the wanted positions.

    Few brackets share a pass, so that the values sorted in its last task stay bounded.
    """
    left = [s for s in searches if s.open_ranks]
    for part in chunks(left, max(1, PICK_ROWS_PER_PASS // max(1, budget))):
        inside = df.selectExpr(*[f"sort_array(collect_list({s.inside()})) as s{i}" for i, s in enumerate(part)])
        picked = inside.selectExpr(*[
            f"array({', '.join(f's{i}[{r - s.upto}]' for r in s.open_ranks)}) as s{i}" for i, s in enumerate(part)
        ]).first()
        for s, values in zip(part, picked):
            s.found.update(zip(s.open_ranks, values))


def _searched(df: DataFrame, cols: dict[str, Column], probs: list[float], counts: dict[str, int],
              budget: int) -> dict[str, list]:
    names = list(cols)
    searches: dict[tuple[str, float], _Search] = {}
    for i, name in enumerate(names):
        for p in probs:
            if counts[name]:
                at = p * (counts[name] - 1)
                ranks = sorted({math.floor(at), math.ceil(at)})
                searches[name, p] = _Search(name, f"q{i}", ranks, 0, counts[name])
    pool = list(searches.values())
    _narrow_all(df, pool, budget)
    _pick_all(df, pool, budget)

    def value(name: str, p: float):
        s = searches.get((name, p))
        if s is None:
            return None
        return interpolate(float(s.found[s.ranks[0]]), float(s.found[s.ranks[-1]]), p * (counts[name] - 1))

    return {name: [value(name, p) for p in probs] for name in names}


def column_quantiles(df: DataFrame, cols: dict[str, Column], probs: list[float],
                     counts: dict[str, int] | None = None, direct_rows: int = DIRECT_QUANTILE_ROWS,
                     budget: int = QUANTILE_BUDGET_ROWS) -> dict[str, list]:
    """Quantiles of several expressions over ``df``: name -> one value per probability (None if empty)."""
    if not cols:
        return {}
    # Plain names, so that the aggregates can be short SQL texts.
    df = df.select(*[c.alias(f"q{i}") for i, c in enumerate(cols.values())])
    if counts is None:
        counts = dict(zip(cols, aggregate_row(df, [f"count({q})" for q in df.columns])))
    if max(counts[name] for name in cols) <= direct_rows:
        values = aggregate_row(df, [f"percentile({q}, {sql_array(probs)})" for q in df.columns])
        return {name: list(v) if v is not None else [None] * len(probs) for name, v in zip(cols, values)}
    return _searched(df, cols, probs, counts, budget)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], **limits) -> dict[str, list]:
    """Exact, linearly interpolated quantiles per column."""
    return column_quantiles(df, {c: statistic_column(df, c) for c in columns}, probs, **limits)


def approximate_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                          accuracy: int = SKETCH_ACCURACY) -> dict[str, list]:
    """One pass, rank error at most 1/accuracy, values taken from the column (no interpolation)."""
    df = df.select(*[statistic_column(df, c).alias(f"q{i}") for i, c in enumerate(columns)])
    values = aggregate_row(df, [f"percentile_approx({q}, {sql_array(probs)}, {accuracy})" for q in df.columns])
    return {c: list(v) if v is not None else [None] * len(probs) for c, v in zip(columns, values)}


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], method: str = "exact",
                   **limits) -> DataFrame:
    """column_name, q, value."""
    find = {"exact": exact_quantiles, "approx": approximate_quantiles}[method]
    values = find(df, columns, probs, **limits)
    rows = [
        (c, float(p), None if v is None else float(v)) for c in columns for p, v in zip(probs, values[c])
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, q double, value double")
