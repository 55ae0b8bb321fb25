"""Column roles: which columns are numbers, categories or dates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, CATEGORICAL, DATETIME, OTHER = "numeric", "categorical", "datetime", "other"


class ColumnRole(NamedTuple):
    position: int
    name: str
    dtype: str
    role: str


def quoted(name: str) -> str:
    """A column name safe for ``F.col``, dots and back ticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def _role(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.StringType):
        return CATEGORICAL
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def column_roles(df: DataFrame) -> list[ColumnRole]:
    """Roles from the schema alone, in schema order. A boolean is ``other``."""
    return [
        ColumnRole(i, f.name, f.dataType.simpleString(), _role(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]


def columns_with_role(df: DataFrame, role: str) -> list[str]:
    return [c.name for c in column_roles(df) if c.role == role]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, CATEGORICAL)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, DATETIME)


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def with_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which every one of the columns is present (NaN is missing too). Any column name will do."""
    for name in names:
        present = column(name).isNotNull()
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            present &= ~F.isnan(column(name))
        df = df.where(present)
    return df


def project_role(df: DataFrame, role: str) -> DataFrame:
    """The columns of one role, in schema order."""
    return df.select(*[column(c) for c in columns_with_role(df, role)])


def rows_of(entries: list[tuple], names: list[str]):
    """``entries`` of Column expressions, one output row each, as a ``stack`` over a one-row table."""
    cells = [cell for entry in entries for cell in entry]
    return F.stack(F.lit(len(entries)), *cells).alias(*names)


def role_table(df: DataFrame) -> DataFrame:
    """position, column_name, dtype, role, non_null.

    A boolean column becomes a category when it has missing values, so the table needs the counts.
    """
    roles = column_roles(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(column(c.name)).alias(f"c{c.position}") for c in roles]
    )

    def role(c: ColumnRole):
        if c.dtype != "boolean":
            return F.lit(c.role)
        return F.when(F.col(f"c{c.position}") < F.col("rows"), CATEGORICAL).otherwise(OTHER)

    entries = [
        (F.lit(c.position), F.lit(c.name), F.lit(c.dtype), role(c), F.col(f"c{c.position}")) for c in roles
    ]
    return counts.select(rows_of(entries, ["position", "column_name", "dtype", "role", "non_null"]))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
