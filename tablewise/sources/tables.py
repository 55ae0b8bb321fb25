"""Reading and writing tables, missing tokens and type inference.

CSV is read as text first, missing tokens become NULL, and the types are decided after that by one
pass over all rows. A token inside a numeric column then cannot decide the type of the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.constants import DATE_RATE, MISSING_TOKENS
from tablewise.functions.dates import parse_date
from tablewise.functions.text import fold_missing
from tablewise.operators.dates import date_columns
from tablewise.operators.quantiles import aggregate_row, chunks
from tablewise.operators.roles import categorical_columns, column
from tablewise.sources.records import OpenQuoteError, line_quotes, read_records
from tablewise.sources.staging import stage

_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_INFINITE = r"^\s*[+-]?[iI]nf(?:inity)?\s*$"
_BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


class EmptyTableError(ValueError):
    """The input has no rows or no columns."""


def require_rows(df: DataFrame) -> DataFrame:
    """Fail early on an input without rows or columns (reads at most one row)."""
    if not df.columns:
        raise EmptyTableError("the table has no columns")
    if df.isEmpty():
        raise EmptyTableError("the table has no rows")
    return df


def normalize_missing(df: DataFrame, tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """NULL for every missing token in a text column and for every NaN in a number column."""
    def folded(field: T.StructField) -> Column:
        c = column(field.name)
        if isinstance(field.dataType, T.StringType):
            return fold_missing(c, tokens).alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return df.select(*[folded(f) for f in df.schema.fields])


def _as_number(c: Column) -> Column:
    plain = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    infinite = F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(_INFINITE), infinite).otherwise(plain)


#: Aggregates that tell the type of a text column
_EVIDENCE = 4


def _type_evidence(c: Column) -> list[Column]:
    """Counts of values: present, 64-bit integers, numbers, booleans."""
    return [F.count(c), F.count_if(c.rlike(_INTEGER) & F.trim(c).try_cast("bigint").isNotNull()),
            F.count_if(c.rlike(f"{_NUMBER}|{_INFINITE}")), F.count_if(c.isin(*_BOOLEANS))]


def _typed(c: Column, rows: int, present: int, integers: int, numbers: int, booleans: int) -> Column | None:
    """The column in the type that its evidence allows, None if it stays text."""
    if integers == rows:
        return F.trim(c).cast("bigint")
    if numbers == present:
        return _as_number(c)
    return F.lower(c) == "true" if booleans == rows else None


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that hold only numbers or booleans, decided over all rows.

    Whole numbers become BIGINT, or DOUBLE when some are missing; a column with no value at all becomes
    DOUBLE. A boolean column with missing values stays text. Everything else, dates included, stays text.
    """
    texts = categorical_columns(df)
    if not texts:
        return df
    rows, *counts = aggregate_row(df, [F.count(F.lit(1))] + [a for c in texts for a in _type_evidence(column(c))])
    return _cast(df, rows, dict(zip(texts, chunks(counts, _EVIDENCE))))


def _cast(df: DataFrame, rows: int, evidence: dict[str, list[int]]) -> DataFrame:
    found = {name: _typed(column(name), rows, *counts) for name, counts in evidence.items()}
    return df.withColumns({name: c for name, c in found.items() if c is not None})


class BrokenCsvError(ValueError):
    """A CSV file whose rows do not fit its header."""


class _CsvText:
    """A CSV table as text, one record a row."""

    def __init__(self, spark: SparkSession, path: str | list[str], settings: dict, tokens: tuple[str, ...]):
        self.spark, self.path, self.settings, self.tokens = spark, path, settings, tokens
        self.delimiter = settings.get("sep", settings.get("delimiter", ","))
        self.quote = settings.get("quote", '"')
        # with line breaks in quotes the reader may take the carriage return before the header's end for a character
        self.names = [n.removesuffix("\r") for n in spark.read.options(**settings).csv(path).columns]

    def simple(self) -> bool:
        """Are the marks single characters, and a quote inside quotes doubled? Other files are Spark's reader's."""
        return (len(self.delimiter.encode()) == len(self.quote.encode()) == 1 and self.settings["escape"] == self.quote
                and not {"lineSep", "comment", "encoding", "charset"} & set(self.settings))

    def fields(self, records: DataFrame, header: Column, *others: Column) -> DataFrame:
        """c0, c1, ...: the fields of each record ``value`` as text, missing tokens folded, all missing for a header; the
        column ``header``; and other columns."""
        columns = [f"c{i}" for i in range(len(self.names))]
        options = {k: str(v) for k, v in self.settings.items() if k not in ("header", "multiLine")} | {"multiLine": "true"}
        row = F.from_csv("value", ", ".join(f"{c} string" for c in columns), options)
        parsed = records.select(F.when(~header, row).alias("row"), header.alias("header"), *others)
        return parsed.select(*[fold_missing(F.col(f"row.{c}"), self.tokens).alias(c) for c in columns],
                             *[F.col(c) for c in parsed.columns if c != "row"])

    def judged(self, fields: DataFrame, facts: list[Column], typed: bool) -> tuple[list, dict[str, list[int]]]:
        """(values of ``facts``, type evidence of each column): one pass, for wide tables one for some 24 columns."""
        columns = [f"c{i}" for i in range(len(self.names) if typed else 0)]
        row = aggregate_row(fields, facts + [a for c in columns for a in _type_evidence(F.col(c))])
        return row[:len(facts)], dict(zip(self.names, chunks(row[len(facts):], _EVIDENCE)))

    def refuse_surplus(self, records: DataFrame, n_fields: Column) -> None:
        row = records.where(n_fields > len(self.names)).select(F.substring("value", 1, 80)).first()
        raise BrokenCsvError(f"a row has more than the {len(self.names)} fields of the header: {row[0]!r}")


def _read_lines(text: _CsvText, typed: bool) -> DataFrame:
    """A record on each line. One pass over the lines judges quotes, fields, headers and types; the rows come from
    Spark's reader, which prunes columns and compares each file's header with the first."""
    reader = text.spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in text.names]))
    plain = normalize_missing(reader.options(**text.settings, enforceSchema=False).csv(text.path), text.tokens)
    lines = text.spark.read.text(text.path).where("trim(value) <> ''")
    first = lines.first()
    if first is None:
        return infer_types(plain) if typed else plain
    header = F.col("value") == F.lit(first["value"])
    open_, n_fields = line_quotes(F.col("value"), text.delimiter, text.quote)
    fields = text.fields(lines, header, open_.alias("open"), n_fields.alias("n_fields"))
    # counts only: a text among the aggregates would take the generated code from all of them
    facts = [F.count(F.lit(1)), F.count_if("header"), F.count_if("open"), F.count_if(F.col("n_fields") > len(text.names))]
    (rows, headers, open_quotes, surplus), counts = text.judged(fields, facts, typed)
    if open_quotes:
        row = lines.where(open_).select(F.substring("value", 1, 80)).first()
        raise BrokenCsvError(f"a quote is not closed at the end of a line: {row[0]!r}; "
                             "a line break inside quotes needs multi_line=True")
    if surplus:
        text.refuse_surplus(lines, n_fields)
    if headers != len(lines.inputFiles()):      # files without a line, another header, or a header among the rows
        by_file = lines.groupBy(F.input_file_name().alias("file")).agg(F.count_if(header).alias("n"))
        least, most = by_file.agg(F.min("n"), F.max("n")).first()
        if not least:
            raise BrokenCsvError(f"a file has another header than {first['value'][:80]!r}")
        if most > 1:        # its names are text in every column
            return plain
    return _cast(plain, rows - headers, counts) if typed else plain


def _read_records(text: _CsvText, typed: bool) -> DataFrame:
    """Records that may have line breaks in quotes, cut by many tasks."""
    records = read_records(text.spark, text.path, text.delimiter, text.quote)
    fields = text.fields(records, F.col("first"), F.col("n_fields"))
    facts = [F.count_if(~F.col("header")), F.count_if(F.col("n_fields") > len(text.names))]
    (rows, surplus), counts = text.judged(fields, facts, typed)
    if surplus:
        text.refuse_surplus(records, F.col("n_fields"))
    headers = records.where("first").select("value").distinct().limit(2).collect()
    if len(headers) > 1:
        raise BrokenCsvError(f"files have differing headers: {headers[0][0][:80]!r} and {headers[1][0][:80]!r}")
    plain = fields.where("not header").select(*[f"c{i}" for i in range(len(text.names))]).toDF(*text.names)
    return _cast(plain, rows, counts) if typed else plain


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             tokens: tuple[str, ...] = MISSING_TOKENS, multi_line: bool = False, staged: bool = False,
             checked: bool = True, **options) -> DataFrame:
    """A CSV file with a header row, its missing tokens folded and its types inferred or given.

    A quote opens a field only where the field starts; elsewhere, as in ``5" pipe``, it is a character. Nothing is lost
    or misplaced in silence: a row with more fields than the header, empty ones included, a file with another header, a
    line break inside quotes without ``multi_line`` and a file that ends inside quotes raise ``BrokenCsvError`` or Spark's
    error for the file. A row with fewer fields has missing values at its end. One pass over the text gives quotes,
    numbers of fields and types; ``checked=False`` infers the types only.

    ``multi_line`` allows line breaks inside quotes. Files are still read by as many tasks as they have blocks
    (``read_records``); only with an escape that is not the quote, marks of several bytes, comments, another line separator
    or encoding does each file go to one task of Spark's reader, unchecked. A header of several lines is allowed.

    ``staged`` writes the typed table once, columnar, for the many passes of a profile or a cleaning: each
    of them would otherwise parse the whole text again.
    """
    settings = {"header": True, "escape": '"', "multiLine": multi_line, **options}
    text = _CsvText(spark, path, settings, tokens)
    typed = schema is None
    if text.simple() and multi_line:
        try:
            table = _read_records(text, typed)
        except OpenQuoteError as error:
            raise BrokenCsvError(str(error)) from error
    elif text.simple() and checked:
        table = _read_lines(text, typed)
    else:
        table = normalize_missing(spark.read.options(**settings).csv(path), tokens)
        table = infer_types(table) if typed else table
    if not typed:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        table = table.select(*[column(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    return stage(table, "csv") if staged else table


def write_csv(df: DataFrame, path: str, **options) -> None:
    """Values as they are: quotes doubled, no whitespace trimmed."""
    df.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    ).csv(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """A cleaned table or a chart table."""
    df.write.format(format).mode(mode).save(path)


def convert_types(df: DataFrame, rate: float = DATE_RATE) -> DataFrame:
    """Opt-in: text columns of which at least ``rate`` of all rows are numbers become DOUBLE, and those
    that are dates become TIMESTAMP_NTZ. What does not convert becomes NULL."""
    texts = categorical_columns(df)
    if not texts:
        return df
    rows, *found = aggregate_row(df, [F.count(F.lit(1))] + [F.count(_as_number(column(c))) for c in texts])
    numbers = [c for c, n in zip(texts, found) if rows and n / rows >= rate]
    dates = date_columns(df, [c for c in texts if c not in numbers])
    return df.withColumns({
        **{c: _as_number(column(c)) for c in numbers},
        **{c: parse_date(column(c), fmt) for c, fmt in dates.items()},
    })
