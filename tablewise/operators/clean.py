"""The cleaning operators. Each one fits what it needs in a few aggregates and returns a projection.

What a fit brings to the driver is one small row per column: counts, medians, modes, bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.constants import (
    OUTLIER_IQR_FACTOR,
    TEXT_MAX_DISTINCT,
    TEXT_ROWS_PER_DISTINCT,
    TITLE_MAX_DISTINCT,
    TITLE_ROWS_PER_DISTINCT,
    UNKNOWN,
)
from tablewise.functions.text import strip, title_case
from tablewise.operators.profile import columns_with_few_values, modes, value_counts
from tablewise.operators.quantiles import aggregate_row, exact_quantiles, sql_number
from tablewise.operators.roles import boolean_columns, categorical_columns, column, free_names, numeric_columns, quoted
from tablewise.sources.staging import stage


def replace_columns(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """One projection: the given columns replaced, the others as they are, in the same order."""
    return df.select(*[
        expressions[c].alias(c) if c in expressions else column(c) for c in df.columns
    ])


# --- missing values -----------------------------------------------------------------------------


@dataclass(frozen=True)
class MissingFit:
    rows: int
    missing: dict[str, int]            # only columns with missing values
    medians: dict[str, float | None]
    modes: dict[str, object]           # UNKNOWN where a column has no value
    spare: dict[str, object] = field(default_factory=dict)   # fills of complete columns, for further rows

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        fills = {c: F.lit(v) for c, v in {**self.medians, **self.modes}.items() if v is not None}
        return {c: F.coalesce(column(c), v) for c, v in fills.items()}

    def spare_expressions(self, df: DataFrame) -> dict[str, Column]:
        """The same for columns that were complete, which keep their type."""
        return {c: F.coalesce(column(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in self.spare.items()
                if v is not None and c in df.columns}


def fit_missing(df: DataFrame, columns: list[str] | None = None, spare: bool = False, **limits) -> MissingFit:
    """Count what is missing, then fit medians and modes of only the columns that need one; with ``spare`` of all."""
    booleans = boolean_columns(df)
    fillable = [
        c for c in numeric_columns(df) + categorical_columns(df) + booleans
        if columns is None or c in columns
    ]
    rows, *present = aggregate_row(df, ["count(1)"] + [f"count({quoted(c)})" for c in fillable])
    counts = dict(zip(fillable, present))
    missing = {c: rows - n for c, n in counts.items() if n < rows}
    wanted = fillable if spare else list(missing)
    numbers = [c for c in numeric_columns(df) if c in wanted]
    medians = exact_quantiles(df, numbers, [0.5], counts={c: counts[c] for c in numbers}, **limits)
    texts = [c for c in df.columns if c in wanted and c not in numbers]
    with_values = [c for c in texts if counts[c]]
    found = {}
    if with_values:
        found = {r["column_name"]: r["mode_value"] for r in modes(df, with_values).collect()}
    fills = {c: found.get(c, UNKNOWN if c not in booleans else None) for c in texts}
    for c in booleans:
        if fills.get(c) is not None:
            fills[c] = fills[c] == "true"
    fitted = {c: m[0] for c, m in medians.items()}
    return MissingFit(rows, missing, {c: v for c, v in fitted.items() if c in missing},
                      {c: v for c, v in fills.items() if c in missing},
                      {c: v for c, v in {**fitted, **fills}.items() if c not in missing})


def impute_median(df: DataFrame) -> DataFrame:
    """Numbers: missing values become the median of the column, which turns into DOUBLE.
    A column without any value stays as it is."""
    return replace_columns(df, fit_missing(df, numeric_columns(df)).expressions(df))


def impute_mode(df: DataFrame) -> DataFrame:
    """Categories: missing values become the most frequent value, the smallest on ties, or 'Unknown'
    where the column has no value at all."""
    return replace_columns(df, fit_missing(df, categorical_columns(df) + boolean_columns(df)).expressions(df))


# --- duplicates ---------------------------------------------------------------------------------


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows. Copies collapse on the map side before the shuffle. A map counts as equal to
    one with the same entries in another order."""
    maps = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    if not maps:
        return df.dropDuplicates()
    entries = replace_columns(df, {c: F.array_sort(F.map_entries(column(c))) for c in maps})
    return replace_columns(entries.dropDuplicates(), {c: F.map_from_entries(column(c)) for c in maps})


#: Bits of the map of repeated hashes: 8,192 bitmaps of 4 KB, 32 MB
_BITMAP_BITS = 28


def drop_duplicate_wide_rows(df: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The same for wide rows (long texts): only rows that may have a copy are shuffled whole.

    A first pass shuffles one 64-bit hash per row and finds the hashes that occur twice. Rows with another
    hash have no copy and pass through; the others are compared in full. The list of repeated hashes is
    broadcast when it is counted to be small. If not, what is broadcast is a bitmap of 2^28 bits, one of which each
    repeated hash sets: a row whose bit is not set has no copy, the others are compared in full, among them the few that
    share a bit with a repeated hash.
    """
    name, = free_names(df, "_hash")
    hashed = df.withColumn(name, F.xxhash64(*[column(c) for c in df.columns]))
    counts = hashed.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(counts.where("n > 1").select(name), "repeated-hashes")
    n_repeated = repeated.count()
    if not n_repeated:
        return df
    if n_repeated > broadcast_rows:
        return _by_bitmap(hashed, repeated, name)
    listed = F.broadcast(repeated)
    single = hashed.join(listed, name, "left_anti")
    copies = hashed.join(listed, name, "left_semi")
    return single.drop(name).unionByName(drop_duplicate_rows(copies.drop(name)))


def _by_bitmap(hashed: DataFrame, repeated: DataFrame, name: str) -> DataFrame:
    """Rows whose hash shares its bit with a repeated one are compared in full, the others pass through."""
    bucket, bits = free_names(hashed, "_bucket", "_bits")

    def place(hash_: Column) -> Column:
        return hash_.bitwiseAND(F.lit((1 << _BITMAP_BITS) - 1))

    maps = stage(repeated.select(place(F.col(name)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits)), "repeated-bitmaps")
    at = F.bitmap_bit_position(place(F.col(name)))
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = hashed.withColumn(bucket, F.bitmap_bucket_number(place(F.col(name)))).join(F.broadcast(maps), bucket, "left")
    is_set = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    single, copies = (marked.where(c).drop(name, bucket, bits) for c in (~is_set, is_set))
    return single.unionByName(drop_duplicate_rows(copies))


# --- outliers -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bounds:
    q1: float
    q3: float
    lower: float
    upper: float


def fit_bounds(df: DataFrame, columns: list[str] | None = None, counts: dict[str, int] | None = None,
               factor: float = OUTLIER_IQR_FACTOR, **limits) -> dict[str, Bounds]:
    """Q1 - 3 IQR and Q3 + 3 IQR of every numeric column that has a value."""
    columns = numeric_columns(df) if columns is None else columns
    fitted = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], counts=counts, **limits).items():
        if q1 is not None:
            q1, q3 = float(q1), float(q3)
            fitted[c] = Bounds(q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return fitted


def outlier_bounds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, q1, q3, lower_bound, upper_bound."""
    rows = [(c, b.q1, b.q3, b.lower, b.upper) for c, b in fit_bounds(df, columns).items()]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, q3 double, lower_bound double, upper_bound double"
    )


def outlier_condition(name: str, bounds: Bounds) -> str:
    c = quoted(name)
    return f"{c} < {sql_number(bounds.lower)} or {c} > {sql_number(bounds.upper)}"


def outlier_aggregates(bounds: dict[str, Bounds]) -> list[str]:
    """The number of values strictly outside the bounds. A missing value is no outlier."""
    return [f"count_if({outlier_condition(c, b)})" for c, b in bounds.items()]


def count_outliers(df: DataFrame, bounds: dict[str, Bounds]) -> dict[str, int]:
    """All columns in one aggregate."""
    return dict(zip(bounds, aggregate_row(df, outlier_aggregates(bounds))))


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_outliers."""
    counts = count_outliers(df, fit_bounds(df, columns))
    return df.sparkSession.createDataFrame(list(counts.items()), "column_name string, n_outliers long")


def capped(name: str, bounds: Bounds) -> Column:
    """The value moved to the nearer bound; missing stays missing (``least`` would skip it)."""
    c = column(name).cast("double")
    return F.when(c < bounds.lower, bounds.lower).when(c > bounds.upper, bounds.upper).otherwise(c)


def capped_in_type(df: DataFrame, name: str, bounds: Bounds) -> Column:
    """The same in the type of the column: a whole number moves to the next whole number within the bounds."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        low, high = math.ceil(max(bounds.lower, -(2.0 ** 62))), math.floor(min(bounds.upper, 2.0 ** 62))
        c = column(name)
        return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c).cast(dtype)
    return capped(name, bounds).cast(dtype)


def cap_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside the bounds become the bound; only columns with such a value change type to DOUBLE."""
    bounds = fit_bounds(df, columns)
    counts = count_outliers(df, bounds)
    return replace_columns(df, {c: capped(c, bounds[c]) for c, n in counts.items() if n})


# --- text ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextFit:
    """One eligible text column: what stripping and title case would do to it."""

    n_unique: int
    n_spaced: int              # values (rows) with whitespace at an end
    n_stripped: int            # distinct values after strip
    n_titled: int              # distinct values after strip and title case
    title_case: bool


def text_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_unique, n_spaced, n_stripped, n_titled, from the frequency table of each column."""
    counts = value_counts(df, columns)
    stripped = strip(F.col("value"))
    return counts.select(
        "column_name", "value", "n", stripped.alias("stripped"),
    ).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.expr("sum(if(length(value) != length(stripped), n, 0))").alias("n_spaced"),
        F.size(F.collect_set("stripped")).alias("n_stripped"),
        F.size(F.collect_set(title_case(F.col("stripped")))).alias("n_titled"),
    )


def distinct_limits(rows: int) -> tuple[int, int]:
    """Most distinct values for a text column to be tidied, and to be title-cased (exclusive)."""
    return (min(TEXT_MAX_DISTINCT, rows // TEXT_ROWS_PER_DISTINCT),
            min(TITLE_MAX_DISTINCT, rows // TITLE_ROWS_PER_DISTINCT))


def fit_text(df: DataFrame, columns: list[str] | None = None) -> dict[str, TextFit]:
    """Eligible text columns only: a sketch of all, then the frequencies of those with few values."""
    columns = categorical_columns(df) if columns is None else columns
    if not columns:
        return {}
    return fit_few_valued(df, *columns_with_few_values(df, columns))


def fit_few_valued(df: DataFrame, rows: int, few: list[str]) -> dict[str, TextFit]:
    """The same for columns already known to have few values, in a table of ``rows`` rows."""
    if not few:
        return {}
    eligible_limit, title_limit = distinct_limits(rows)
    found = {r["column_name"]: r for r in text_counts(df, few).collect()}
    return {
        c: TextFit(r["n_unique"], r["n_spaced"], r["n_stripped"], r["n_titled"], r["n_stripped"] < title_limit)
        for c in few if (r := found.get(c)) and r["n_unique"] <= eligible_limit
    }


def tidied(name: str, fit: TextFit) -> Column:
    """The text expression for an eligible column."""
    c = column(name)
    if fit.n_spaced:
        c = strip(c)
    return title_case(c) if fit.title_case else c


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text, booleans as Python prints them."""
    c = column(name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def text_eligibility(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_unique, eligible, title_case for every text column, with exact counts."""
    columns = categorical_columns(df) if columns is None else columns
    rows = F.lit(df.count())
    limit = F.least(F.lit(TEXT_MAX_DISTINCT), F.floor(rows / TEXT_ROWS_PER_DISTINCT))
    title_limit = F.least(F.lit(TITLE_MAX_DISTINCT), F.floor(rows / TITLE_ROWS_PER_DISTINCT))
    distinct = value_counts(df, columns).select("column_name", strip(F.col("value")).alias("stripped"))
    # Distinct stripped values through a second grouping, never a set in memory: a text may have many.
    counts = distinct.groupBy("column_name", "stripped").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "column_name"
    ).agg(F.sum("n").alias("n_unique"), F.count(F.lit(1)).alias("n_stripped"))
    eligible = F.col("n_unique") <= limit
    return counts.select(
        "column_name", "n_unique", eligible.alias("eligible"),
        (eligible & (F.col("n_stripped") < title_limit)).alias("title_case"),
    )


def strip_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Eligible text columns without whitespace at the ends."""
    fitted = fit_text(df, columns)
    return replace_columns(df, {c: strip(column(c)) for c, f in fitted.items() if f.n_spaced})


def title_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Eligible text columns stripped, and in title case where they have few distinct values."""
    fitted = fit_text(df, columns)
    return replace_columns(df, {c: tidied(c, f) for c, f in fitted.items()})
