"""The profile of a table: shape, statistics, frequencies, missing and distinct counts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablewise.constants import (
    AGGREGATES_PER_PASS,
    BAR_TOP_VALUES,
    DISTINCT_GATE,
    PREVIEW_ROWS,
    PROFILE_TOP_VALUES,
    SHORT_STATS_COLUMNS,
)
from tablewise.operators.quantiles import aggregate_row, chunks, exact_quantiles
from tablewise.operators.roles import categorical_columns, column, numeric_columns, quoted

QUARTILES = [0.25, 0.5, 0.75]
#: Counters of a summary of frequent values, candidates that it reports, columns whose summaries share a scan
TRACKED_VALUES, MOST_CANDIDATES, SUMMARIES_PER_PASS = 10_000, 100, 24
STATS_SCHEMA = "column_name string, cnt bigint, mean double, std double, min double, max double"


def sql_text(value: str) -> str:
    """A string literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stack_rows(df: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """SQL expressions over a one-row table turned into one row each."""
    cells = ", ".join(cell for row in rows for cell in row)
    return df.selectExpr(f"stack({len(rows)}, {cells}) as ({', '.join(names)})")


def _in_parts(df: DataFrame, columns: list[str], size: int, build: Callable[[list[str]], DataFrame], schema: str
              ) -> DataFrame:
    """The table of ``build`` over groups of columns, so that a wide table keeps its generated code. Without columns
    it is the empty table of ``schema``."""
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [build(part) for part in chunks(columns, size)])


def _one_per_column(df: DataFrame, columns: list[str], aggregate: str, name: str) -> DataFrame:
    """column_name and one aggregate of it."""
    def part(chosen: list[str]) -> DataFrame:
        values = df.selectExpr(*[f"{aggregate.format(quoted(c))} as n{i}" for i, c in enumerate(chosen)])
        return stack_rows(values, [[sql_text(c), f"n{i}"] for i, c in enumerate(chosen)], ["column_name", name])

    return _in_parts(df, columns, AGGREGATES_PER_PASS, part, f"column_name string, {name} bigint")


def preview(df: DataFrame, key: list[str] | None = None, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows; give a key for the same rows every time."""
    return (df.orderBy(*key) if key else df).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """n_rows, n_cols."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def basic_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, cnt, mean, std, min, max of the numeric columns: one aggregate over one scan."""
    columns = numeric_columns(df) if columns is None else columns
    names = ["column_name", "cnt", "mean", "std", "min", "max"]

    def part(chosen: list[str]) -> DataFrame:
        aggregates, rows = [], []
        for i, name in enumerate(chosen):
            c = quoted(name)
            aggregates += [
                f"count({c}) as n{i}", f"avg(double({c})) as m{i}", f"stddev_samp(double({c})) as s{i}",
                f"double(min({c})) as lo{i}", f"double(max({c})) as hi{i}",
            ]
            rows.append([sql_text(name), f"n{i}", f"m{i}", f"s{i}", f"lo{i}", f"hi{i}"])
        return stack_rows(df.selectExpr(*aggregates), rows, names)

    # eight sums and extremes per column
    return _in_parts(df, columns, AGGREGATES_PER_PASS // 8, part, STATS_SCHEMA)


def describe(df: DataFrame, columns: list[str] | None = None, **limits) -> DataFrame:
    """column_name, cnt, mean, std, min, q25, q50, q75, max per numeric column, quartiles exact."""
    columns = numeric_columns(df) if columns is None else columns
    # One pass gives the counts that the quantile search starts from, and the other statistics.
    stats = {r["column_name"]: r for r in basic_stats(df, columns).collect()}
    quartiles = exact_quantiles(df, columns, QUARTILES, counts={c: stats[c]["cnt"] for c in columns}, **limits)
    rows = [
        (c, stats[c]["cnt"], stats[c]["mean"], stats[c]["std"], stats[c]["min"],
         *[None if q is None else float(q) for q in quartiles[c]], stats[c]["max"])
        for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, cnt long, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double",
    )


def short_stats(df: DataFrame, n: int = SHORT_STATS_COLUMNS) -> DataFrame:
    """column_name, min, max, mean, std of the first numeric columns, at two decimals."""
    stats = basic_stats(df, numeric_columns(df)[:n])
    return stats.select("column_name", *[F.round(c, 2).alias(c) for c in ("min", "max", "mean", "std")])


def missing_counts(df: DataFrame, only_positive: bool = False) -> DataFrame:
    """column_name, n_missing for every column."""
    table = _one_per_column(df, df.columns, "count_if({} is null)", "n_missing")
    return table.where("n_missing > 0") if only_positive else table


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value, n: how often each value occurs, missing values left out.

    All columns share one scan and one shuffle of (column, value), counted on the map side first, so a
    value that fills the table arrives as one row per task.
    """
    columns = categorical_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    return _frequencies(df, columns).where("value is not null")


def _frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    texts = df.select(*[column(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], [column(c) for c in columns], "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = PROFILE_TOP_VALUES) -> DataFrame:
    """column_name, value, n, rnk: the k most frequent values of each column; ties by value.

    One scan sketches every column. A column with few values is counted by value, and the rank limit is pushed below
    the shuffle, so at most k rows per column and task are moved. Of a column with many, only the candidates of a summary
    of frequent items are counted, if that proves the result (``heavy_values``); if the k-th value is not clearly more
    frequent than the rest, every value is counted.
    """
    columns = categorical_columns(df) if columns is None else columns
    heavy = heavy_values(df, columns, k) if columns else {}
    order = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = value_counts(df, [c for c in columns if c not in heavy]).withColumn("rnk", F.row_number().over(order))
    counted = ranked.where(F.col("rnk") <= k)
    if not heavy:
        return counted
    rows = [(c, v, n, r) for c, found in heavy.items() for r, (v, n) in enumerate(found, 1)]
    proven = df.sparkSession.createDataFrame(rows, counted.schema)
    return proven if len(heavy) == len(columns) else counted.unionByName(proven)


def heavy_values(df: DataFrame, columns: list[str], k: int) -> dict[str, list[tuple[str, int]]]:
    """The k most frequent values with their exact counts, of those columns with many values where that can be proven
    without counting every value.

    A mergeable summary of ``TRACKED_VALUES`` counters proposes candidates; a second scan counts them exactly. Of N values
    the summary's counts are at most E = 3.5 N / size off. A value that it does not report has at most 2 E occurrences, or
    at most the last reported count where the report is full; if the k-th candidate has more, no other value can be
    among the k. What travels are the counters of each task and a few candidates, however many values there are.
    """
    size = 1 << math.ceil(math.log2(TRACKED_VALUES / 0.75))
    reported: dict[str, tuple[list, float]] = {}
    for part in chunks(columns, SUMMARIES_PER_PASS):
        row = df.selectExpr("count(1) as rows", *distinct_sketches(part), *[
            f"approx_top_k(cast({quoted(c)} as string), {MOST_CANDIDATES}, {TRACKED_VALUES}) as t{i}" for i, c in enumerate(part)]).first()
        rows, estimates, tops = row[0], row[1:len(part) + 1], row[len(part) + 1:]
        few = set(few_valued(part, list(estimates)))
        for c, top in zip(part, tops):
            if c not in few:
                unseen = max(2 * 3.5 * rows / size, top[-1]["count"] if len(top) == MOST_CANDIDATES else 0)
                reported[c] = [t["item"] for t in top if t["item"] is not None], unseen
    candidates = [(c, v) for c, (values, _) in reported.items() if len(values) >= k for v in values]
    if not candidates:
        return {}
    listed = df.sparkSession.createDataFrame(candidates, "column_name string, value string")
    texts = df.select(*[column(c).cast("string").alias(c) for c in dict(candidates)])
    long = texts.unpivot([], [column(c) for c in texts.columns], "column_name", "value")
    counts = long.join(F.broadcast(listed), ["column_name", "value"]).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    found: dict[str, list[tuple[str, int]]] = {}
    for r in counts.collect():      # at most MOST_CANDIDATES rows per column
        found.setdefault(r["column_name"], []).append((r["value"], r["n"]))
    best = {c: sorted(values, key=lambda x: (-x[1], x[0].encode()))[:k] for c, values in found.items()}
    return {c: values for c, values in best.items() if len(values) == k and values[-1][1] > reported[c][1]}


def bar_values(df: DataFrame, name: str, k: int = BAR_TOP_VALUES) -> DataFrame:
    """column_name, value, n, rnk of one column, most frequent first."""
    return top_values(df, [name], k)


def modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, mode_value: the most frequent value, the smallest of them on ties."""
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), "value"))
    counts = value_counts(df, columns)
    return counts.groupBy("column_name").agg(best["value"].alias("mode_value"))


PROFILE_COLUMNS = ["column_name", "n_missing", "n_unique", "mean", "std", "min", "max"]
_FAMILIES = ("bigint", "double", "string", "timestamp_ntz")


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp_ntz"
    return "string"


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (i, one value column per type family, n): each distinct value of each column, typed."""
    families = {c: _family(df.schema[c].dataType) for c in columns}
    used = [f for f in _FAMILIES if f in families.values()]
    cells = []
    for i, c in enumerate(columns):
        cells.append(str(i))
        value = quoted(c)
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = f"if({value} is null, null, to_json(named_struct('v', {value})))"
        cells += [f"cast({value} as {f})" if f == families[c] else f"cast(null as {f})" for f in used]
    names = [f"v{k}" for k in range(len(used))]
    long = df.selectExpr(f"stack({len(columns)}, {', '.join(cells)}) as (i, {', '.join(names)})")
    long = long.withColumn("present", F.expr(" or ".join(f"{v} is not null" for v in names)))
    return long.groupBy("i", *names, "present").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, n_missing, n_unique, and for numbers mean, std, min, max: one row per column.

    With sketches of the distinct counts every column is read once, and one row per task moves. Exact counts take a scan of
    their own: sums that travel with every distinct value cost more than reading the table again.
    """
    columns = df.columns
    if not exact:
        def part(chosen: list[str]) -> DataFrame:
            aggregates, rows = [], []
            for i, name in enumerate(chosen):
                c, number = quoted(name), isinstance(df.schema[name].dataType, T.NumericType)
                own = [f"{f}(double({c})) as {f}{i}" for f in ("avg", "stddev_samp", "min", "max")] if number else []
                aggregates += [f"count_if({c} is null) as m{i}", f"approx_count_distinct({c}) as u{i}", *own]
                rows.append([sql_text(name), f"m{i}", f"u{i}", *([a.split()[-1] for a in own] or ["cast(null as double)"] * 4)])
            return stack_rows(df.selectExpr(*aggregates), rows, PROFILE_COLUMNS)

        return _in_parts(df, columns, AGGREGATES_PER_PASS // 9, part,
                         "column_name string, n_missing bigint, n_unique bigint, mean double, std double, min double, max double")
    info = column_info(df).select("column_name", F.col("n_null").alias("n_missing"), "n_unique")
    stats = basic_stats(df).select("column_name", *PROFILE_COLUMNS[3:])
    return info.join(F.broadcast(stats), "column_name", "left")   # one row per column on both sides


def _per_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, non_null, n_null, n_unique: exact, from the distinct values."""
    return _distinct_values(df, columns).groupBy("i").agg(
        F.expr("sum(if(present, n, 0))").alias("non_null"),
        F.expr("sum(if(present, 0, n))").alias("n_null"),
        F.expr("count_if(present)").alias("n_unique"),
    )


def _named(df: DataFrame, columns: list[str]):
    """The column name for index ``i`` as an expression: no join with a list of names is needed."""
    return F.expr(f"element_at(array({', '.join(sql_text(c) for c in columns)}), int(i + 1))")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_unique: exact number of distinct values, missing values left out."""
    columns = df.columns if columns is None else columns
    return _per_column(df, columns).select(_named(df, columns).alias("column_name"), "n_unique")


def approximate_distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_unique from one HyperLogLog sketch per column: one scan, no shuffle of values."""
    columns = df.columns if columns is None else columns
    return _one_per_column(df, columns, "approx_count_distinct({})", "n_unique")


def columns_with_few_values(df: DataFrame, columns: list[str],
                            limit: int = DISTINCT_GATE) -> tuple[int, list[str]]:
    """The row count, and the columns that can have few distinct values by one sketch per column: one pass.

    The limit is twice every threshold, far outside the error of the sketch; exact counts are then taken
    from what is left.
    """
    rows, *estimates = aggregate_row(df, ["count(1)"] + distinct_sketches(columns))
    return rows, few_valued(columns, estimates, limit)


def distinct_sketches(columns: list[str]) -> list[str]:
    return [f"approx_count_distinct({quoted(c)})" for c in columns]


def few_valued(columns: list[str], estimates: list[int], limit: int = DISTINCT_GATE) -> list[str]:
    return [c for c, n in zip(columns, estimates) if n <= limit]


def column_info(df: DataFrame, exact: bool = True) -> DataFrame:
    """column_name, dtype, non_null, n_null, n_unique for every column."""
    columns = df.columns
    dtypes = [f.dataType.simpleString() for f in df.schema.fields]
    if exact:
        dtype = F.expr(f"element_at(array({', '.join(sql_text(t) for t in dtypes)}), int(i + 1))")
        return _per_column(df, columns).select(
            _named(df, columns).alias("column_name"), dtype.alias("dtype"), "non_null", "n_null", "n_unique"
        )
    names = ["column_name", "dtype", "non_null", "n_null", "n_unique"]

    def part(chosen: list[str]) -> DataFrame:
        aggregates, rows = [], []
        for i, name in enumerate(chosen):
            c, dtype = quoted(name), df.schema[name].dataType.simpleString()
            aggregates += [f"count({c}) as c{i}", f"count_if({c} is null) as m{i}",
                           f"approx_count_distinct({c}) as u{i}"]
            rows.append([sql_text(name), sql_text(dtype), f"c{i}", f"m{i}", f"u{i}"])
        return stack_rows(df.selectExpr(*aggregates), rows, names)

    return _in_parts(df, columns, AGGREGATES_PER_PASS // 3, part,
                     "column_name string, dtype string, non_null bigint, n_null bigint, n_unique bigint")


def group_means(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """group_value and the mean of every feature; rows without a group are left out."""
    return df.where(column(group).isNotNull()).groupBy(column(group).alias("group_value")).agg(
        *[F.avg(column(f).cast("double")).alias(f) for f in features]
    )
