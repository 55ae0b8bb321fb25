"""Finding and materialising dates held as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tablewise.constants import DATE_HEAD_ROWS, DATE_RATE, DATE_SAMPLE_NEEDED, DATE_SAMPLE_SIZE
from tablewise.functions.dates import DATE_FORMATS, DateFormat, parse_any_date, parse_date, with_date_mask
from tablewise.operators.profile import columns_with_few_values, value_counts
from tablewise.operators.roles import categorical_columns, column


def detect_by_sample(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """column_name, n_sampled, n_parsed, is_date: do 3 of the first 5 present values parse?

    "First" is by ``key``. The first rows of the table hold five values of most columns: one scan in which every task
    keeps those rows. Columns that are mostly missing there share a second scan, with five rows for each column and task.
    """
    columns = categorical_columns(df) if columns is None else columns
    empty = df.sparkSession.createDataFrame([], "column_name string, value string")
    if not columns:
        return _judged(empty, [])
    order = [column(k).asc_nulls_last() for k in key]
    head = df.orderBy(*order).limit(DATE_HEAD_ROWS).select(*[column(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = head.collect()       # a bounded number of rows of texts
    first = {c: [r[i] for r in rows if r[i] is not None][:DATE_SAMPLE_SIZE] for i, c in enumerate(columns)}
    rest = [c for c in columns if len(first[c]) < DATE_SAMPLE_SIZE] if len(rows) == DATE_HEAD_ROWS else []
    sample = df.sparkSession.createDataFrame(
        [(c, v) for c, values in first.items() if c not in rest for v in values], empty.schema)
    if rest:
        keyed = df.select(F.struct(*[column(k) for k in key]).alias("_key"),
                          *[column(c).cast("string").alias(c) for c in rest])
        long = keyed.unpivot("_key", [column(c) for c in rest], "column_name", "value").where("value is not null")
        ranked = long.withColumn("n", F.row_number().over(
            W.partitionBy("column_name").orderBy(F.col("_key").asc_nulls_last())))
        sample = sample.union(ranked.where(F.col("n") <= DATE_SAMPLE_SIZE).select("column_name", "value"))
    return _judged(sample, columns)


def _judged(sample: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column, also one without any value."""
    counts = sample.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count(parse_any_date(F.col("value"))).alias("n_parsed"))
    names = sample.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(F.broadcast(counts), "column_name", "left").fillna(0, ["n_sampled", "n_parsed"]).withColumn(
        "is_date", F.col("n_parsed") >= DATE_SAMPLE_NEEDED)


@dataclass(frozen=True)
class CategoryFacts:
    """What chart plans need to know of the text columns."""

    distinct: dict[str, int]                        # exact, only of columns with few values
    formats: dict[str, tuple[DateFormat, float]]    # the best date format of each column and its rate

    @property
    def dates(self) -> dict[str, DateFormat]:
        return {c: fmt for c, (fmt, rate) in self.formats.items() if rate >= DATE_RATE}


def _best(parsed: list[int], rows: int) -> tuple[DateFormat, float]:
    top = max(range(len(parsed)), key=lambda k: (parsed[k], -k))
    return DATE_FORMATS[top], parsed[top] / rows if rows else 0.0


def _bit(k: int) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << k)) != 0


def category_facts(df: DataFrame, columns: list[str] | None = None) -> CategoryFacts:
    """Distinct counts and date formats of text columns. A missing value counts as a failed parse.

    Columns with few values are judged by their frequency table: each value is parsed once, however often
    it occurs. The others are parsed row by row, their values one below the other, so that one expression serves
    any number of columns. A value is taken apart once for all formats.
    """
    columns = categorical_columns(df) if columns is None else columns
    if not columns:
        return CategoryFacts({}, {})
    rows, few = columns_with_few_values(df, columns)
    many = [c for c in columns if c not in few]
    distinct, formats = {}, {}
    if few:
        values = with_date_mask(value_counts(df, few), "value", keep=["column_name", "n"])
        counts = values.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_unique"),
            *[F.sum(F.when(_bit(k), F.col("n")).otherwise(0)).alias(f"p{k}") for k in range(len(DATE_FORMATS))])
        found = {r["column_name"]: r for r in counts.collect()}
        for c in few:
            r = found.get(c)
            distinct[c] = r["n_unique"] if r else 0
            formats[c] = _best([r[f"p{k}"] if r else 0 for k in range(len(DATE_FORMATS))], rows)
    if many:
        long = df.select(F.posexplode(F.array(*[column(c).cast("string") for c in many])).alias("i", "value"))
        counts = with_date_mask(long, "value", keep=["i"]).groupBy("i").agg(
            *[F.count_if(_bit(k)).alias(f"p{k}") for k in range(len(DATE_FORMATS))])
        found = {r["i"]: list(r)[1:] for r in counts.collect()}     # one row per column
        formats |= {c: _best(found.get(i, [0] * len(DATE_FORMATS)), rows) for i, c in enumerate(many)}
    return CategoryFacts(distinct, {c: formats[c] for c in columns})


def date_columns(df: DataFrame, columns: list[str] | None = None) -> dict[str, DateFormat]:
    """Text columns of which at least 80% of all rows parse, with their format."""
    return category_facts(df, columns).dates


def detect_by_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, rate, is_date."""
    rows = [(c, float(rate), rate >= DATE_RATE) for c, (_, rate) in category_facts(df, columns).formats.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, rate double, is_date boolean")


def materialize_dates(df: DataFrame, formats: dict[str, DateFormat] | None = None) -> DataFrame:
    """Add ``<column>_date`` (TIMESTAMP_NTZ) beside every date text; NULL where it does not parse."""
    formats = date_columns(df) if formats is None else formats
    return df.withColumns({f"{c}_date": parse_date(column(c), fmt) for c, fmt in formats.items()})
