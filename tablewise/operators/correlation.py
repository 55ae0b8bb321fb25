"""Pairwise Pearson correlation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.constants import AGGREGATES_PER_PASS
from tablewise.operators.quantiles import aggregate_row, chunks, sql_number
from tablewise.operators.roles import numeric_columns, quoted

_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair of columns of the partition: how many rows have both values, and the sums of both, of
    their squares and of their products over those rows. Missing values are 0 beside an indicator that is 0."""
    total = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
        values = np.stack(columns, 1) if batch.num_rows else np.zeros((0, batch.num_columns))
        present = (~np.isnan(values)).astype(float)
        values = np.where(present > 0, values, 0.0)
        squares = values * values
        part = np.stack([present.T @ present, values.T @ present, present.T @ values, squares.T @ present,
                         present.T @ squares, values.T @ values])
        total = part if total is None else total + part
    if total is not None:
        a, b = np.triu_indices(total.shape[1], 1)
        yield pa.record_batch([pa.array(a), pa.array(b), *[pa.array(t[a, b]) for t in total]], names=["a", "b", *_SUMS])


def _pairs_with_missing(values: DataFrame) -> dict[tuple[str, str], float]:
    """r for every pair, from one scan whatever the number of columns: each partition gives one small matrix, and Spark
    adds them up. ``values`` are centred, so the sums lose nothing to cancellation."""
    schema = "a bigint, b bigint, " + ", ".join(f"{c} double" for c in _SUMS)
    sums = values.mapInArrow(_products, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    names, found = values.columns, {}
    for r in sums.collect():
        pair = names[r["a"]], names[r["b"]]
        if not r["n"]:
            found[pair] = None
            continue
        saa, sbb = (r[s + s[-1]] - r[s] * r[s] / r["n"] for s in ("sa", "sb"))
        # what rounding leaves of a column that is constant over these rows is no spread
        scale = max(0.0, saa) ** 0.5 * max(0.0, sbb) ** 0.5
        flat = saa <= 1e-14 * r["saa"] or sbb <= 1e-14 * r["sbb"]
        found[pair] = None if flat or not scale else (r["sab"] - r["sa"] * r["sb"] / r["n"]) / scale
    return found


def _complete_pairs(df: DataFrame, columns: list[str], rows: int) -> dict[tuple[str, str], float]:
    """r for columns without missing values: they share one sum and one square sum per column.

    ``df`` holds the values minus their mean, so the sums lose nothing to cancellation.
    """
    pairs = list(combinations(columns, 2))
    sums = aggregate_row(
        df,
        [f"sum({c})" for c in columns] + [f"sum({c} * {c})" for c in columns]
        + [f"sum({a} * {b})" for a, b in pairs],
    )
    k = len(columns)
    total, square = dict(zip(columns, sums[:k])), dict(zip(columns, sums[k:2 * k]))

    def spread(c: str) -> float:
        return max(0.0, square[c] - total[c] * total[c] / rows) ** 0.5

    found = {}
    for (a, b), product in zip(pairs, sums[2 * k:]):
        scale = spread(a) * spread(b)
        found[a, b] = (product - total[a] * total[b] / rows) / scale if scale else None
    return found


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """col_x, col_y, r for every ordered pair, over the rows where both are present.

    One pass takes counts, ranges and means. A few columns without missing values share one pass of plain sums around
    their means; otherwise one more pass multiplies all columns with each other, so that the number of scans does not
    grow with the pairs. NULL where a column is constant or empty.
    """
    columns = numeric_columns(df) if columns is None else columns
    values = df.selectExpr(*[f"double({quoted(c)}) as c{i}" for i, c in enumerate(columns)])
    names = values.columns
    rows, *facts = aggregate_row(values, ["count(1)"] + [
        f"{f}({c})" for c in names for f in ("count", "min", "max", "avg")
    ])
    counts = dict(zip(names, chunks(facts, 4)))
    varying = [c for c in names if counts[c][0] and counts[c][1] < counts[c][2]]
    complete = [c for c in varying if counts[c][0] == rows]

    found: dict[tuple[str, str], float] = {}
    if len(varying) > 1:
        centred = values.selectExpr(*[f"{c} - {sql_number(float(counts[c][3]))} as {c}" for c in varying])
        k = len(varying)
        if len(complete) == k and 2 * k + k * (k - 1) // 2 <= AGGREGATES_PER_PASS:
            found = _complete_pairs(centred, varying, rows)
        else:
            found = _pairs_with_missing(centred)

    def r(a: str, b: str):
        if a == b:
            return 1.0 if a in varying else None
        return found.get((a, b), found.get((b, a)))

    table = [(x, y, r(a, b)) for x, a in zip(columns, names) for y, b in zip(columns, names)]
    return df.sparkSession.createDataFrame(table, "col_x string, col_y string, r double")
