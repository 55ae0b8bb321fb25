"""Date parsing from explicit formats.

A format is a shape (a regular expression) and a rewrite to ISO order. A value is looked at in rising cost:
its size, a separator of the format, the shape, and only then the cast to TIMESTAMP_NTZ that rejects a
30th of February. Text that is no date rarely gets beyond the separator, and no session time zone is
involved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A time of day, with AM or PM, or with a zone. The zone is dropped: the result is the local time as written.
_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|[+-]\d{2}:?(?:\d{2})?))?)?"
_YEAR, _MONTH, _DAY = r"(\d{4})", r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
_NAMES = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
          "|nov(?:ember)?|dec(?:ember)?")
_NAME = rf"((?i:{_NAMES}))\.?"
_MAX_BYTES = 40


@dataclass(frozen=True)
class DateFormat:
    name: str
    marks: str        # separators, of which a value must have one
    shape: str        # with the groups the rewrite refers to
    rewrite: str      # a replacement that gives yyyy-M-d and an optional time
    month_names: bool = False


# Fixed list. On a tie between formats the earlier one wins.
DATE_FORMATS: tuple[DateFormat, ...] = (
    DateFormat("yyyy-M-d", "-", rf"^{_YEAR}-{_MONTH}-{_DAY}({_TIME})\z", "$1-$2-$3$4"),
    DateFormat("M/d/yyyy", "/", rf"^{_MONTH}/{_DAY}/{_YEAR}({_TIME})\z", "$3-$1-$2$4"),
    DateFormat("d/M/yyyy", "/", rf"^{_DAY}/{_MONTH}/{_YEAR}({_TIME})\z", "$3-$2-$1$4"),
    DateFormat("yyyy/M/d", "/", rf"^{_YEAR}/{_MONTH}/{_DAY}({_TIME})\z", "$1-$2-$3$4"),
    DateFormat("d.M.yyyy", ".", rf"^{_DAY}\.{_MONTH}\.{_YEAR}({_TIME})\z", "$3-$2-$1$4"),
    DateFormat("MMM d, yyyy", " ", rf"^{_NAME} {_DAY},? {_YEAR}\z", "$3-$1-$2", True),
    DateFormat("d MMM yyyy", " -", rf"^{_DAY}[ -]{_NAME}[ -]{_YEAR}\z", "$3-$2-$1", True),
    DateFormat("M/d/yy", "/", rf"^{_MONTH}/{_DAY}/(\d{{2}})({_TIME})\z", "$3-$1-$2$4"),
    DateFormat("d/M/yy", "/", rf"^{_DAY}/{_MONTH}/(\d{{2}})({_TIME})\z", "$3-$2-$1$4"),
    DateFormat("yyyyMMdd", "", r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\z", "$1-$2-$3"),
)
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def format_named(name: str) -> DateFormat:
    for fmt in DATE_FORMATS:
        if fmt.name == name:
            return fmt
    raise ValueError(f"unknown date format {name!r}; known: {[f.name for f in DATE_FORMATS]}")


def parse_date(col: Column, fmt: DateFormat) -> Column:
    """TIMESTAMP_NTZ, or NULL where the text is not a date in this format."""
    iso = F.regexp_replace(col, fmt.shape, fmt.rewrite)
    if fmt.month_names:
        month = F.array_position(
            F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.regexp_extract(iso, "-([A-Za-z]{3})[A-Za-z]*-", 1))
        )
        iso = F.concat(
            F.substring(iso, 1, 5), F.nullif(month, F.lit(0)).cast("string"), F.lit("-"),
            F.regexp_extract(iso, r"-(\d{1,2})$", 1),
        )
    elif fmt.name.endswith("/yy"):      # the usual window: 1969 to 2068
        century = F.when(F.substring(iso, 1, 2) >= "69", "19").otherwise("20")
        iso = F.concat(century, iso)
    if "(?: ?[AaPp][Mm])" in fmt.shape:
        iso = F.when(col.rlike("[AaPp][Mm]"), _of_24_hours(iso)).otherwise(iso)
    cheap = F.octet_length(col) <= _MAX_BYTES
    if fmt.marks:
        cheap &= reduce(or_, [col.contains(mark) for mark in fmt.marks])
    return F.when(cheap & col.rlike(fmt.shape), iso.try_cast("timestamp_ntz"))


def _of_24_hours(iso: Column) -> Column:
    """``y-M-d h:mm:ss PM`` with the hour from 0 to 23; NULL if the hour is not one of 1 to 12."""
    def part(i: int) -> Column:
        return F.regexp_extract(iso, r"^(\S+?)[ T](\d{1,2})(:[\d:.]+) ?([AaPp])[Mm]", i)

    hour = part(2).try_cast("int")
    late = F.when(F.upper(part(4)) == "P", 12).otherwise(0)
    return F.when(hour.between(1, 12), F.concat(part(1), F.lit(" "), (hour % 12 + late).cast("string"), part(3)))


def parse_any_date(col: Column) -> Column:
    """The first format that parses this one value."""
    return F.coalesce(*[parse_date(col, fmt) for fmt in DATE_FORMATS])


# One grammar for all formats: three numbers with one separator and perhaps a time, a month's name between a day and a
# year, eight digits. A value is taken apart once; which formats it fits follows from the sizes and ranges of its parts.
_NUMBERS = rf"^\d{{1,4}}([-/.])\d{{1,2}}\1\d{{1,4}}{_TIME}\z"
_NAMED = rf"^(?:{_NAME} {_DAY},? |{_DAY}[ -]{_NAME}[ -]){_YEAR}\z"
_EIGHT = r"^(?:19|20)\d{6}\z"


def with_date_mask(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``mask``: a number whose bit k is set if the value is a date in ``DATE_FORMATS[k]``, as
    ``parse_date`` reads it; 0 for a missing value.

    Steps are separate projections, so that each part of a value is computed once, however many formats look at it.
    """
    def step(rows: DataFrame, kept: str, **parts: str) -> DataFrame:
        return rows.select(*keep, *kept.split(), *[F.expr(e).alias(name) for name, e in parts.items()])

    rows = df.select(*keep, F.when(F.octet_length(value) <= _MAX_BYTES, F.col(value)).alias("_v"))
    rows = step(rows, "_v", _kind=f"""case when _v rlike r'{_NUMBERS}' then 1 when _v rlike r'{_NAMED}' then 2
        when _v rlike r'{_EIGHT}' then 3 else 0 end""")
    # day, month and year with separators between
    rows = step(rows, "_v _kind", _date=f"""case _kind when 1 then substring_index(substring_index(_v, ' ', 1), 'T', 1)
        when 2 then regexp_replace(_v, r'{_NAMED}', '$5-$1$4-$2$3')
        when 3 then concat(left(_v, 4), '-', substr(_v, 5, 2), '-', right(_v, 2)) end""")
    rows = step(rows, "_v _kind _date", _mark="if(_kind = 1, left(translate(_date, '0123456789', ''), 1), '-')",
                _time="if(_kind = 1, substr(_v, length(_date) + 1), '')")
    clock = F.concat(F.lit("2000-1-1"), F.col("_time"))
    clock = F.when(F.col("_time").rlike("[AaPp][Mm]"), _of_24_hours(clock)).otherwise(clock)
    sound = F.when(F.col("_time") == "", True).otherwise(clock.try_cast("timestamp_ntz").isNotNull())
    rows = step(rows.withColumn("_sound", sound), "_v _kind _mark _sound", _a="substring_index(_date, _mark, 1)",
                _b="substring_index(substring_index(_date, _mark, 2), _mark, -1)", _c="substring_index(_date, _mark, -1)")
    months = ", ".join(f"'{m}'" for m in _MONTHS)
    rows = step(rows, "_v _kind _mark _sound", _x="try_cast(_a as int)", _z="try_cast(_c as int)",
                _y=f"if(_kind = 2, int(array_position(array({months}), lower(left(_b, 3)))), try_cast(_b as int))",
                _form="""case when length(_a) = 4 and length(_c) <= 2 then 'first' when length(_a) > 2 then ''
                    when length(_c) = 4 then 'last' when length(_c) = 2 then 'short' else '' end""")
    # the year, and month and day in the one order that a year in front allows, or in both
    rows = step(rows, "_v _kind _mark _sound _form", _year="if(_form = 'first', _x, if(_form = 'last', _z, _z + if(_z >= 69, 1900, 2000)))",
                _m="if(_form = 'first', _y, _x)", _d="if(_form = 'first', _z, _y)")
    rows = step(rows, "_v _kind _mark _sound _form", _md=_in_calendar("_m", "_d"), _dm=_in_calendar("_d", "_m"))

    def bits(*formats: str) -> int:
        return sum(1 << k for k, fmt in enumerate(DATE_FORMATS) if fmt.name in formats)

    return step(rows, "", mask=f"""case when not _sound or _kind = 0 or _form = '' then 0
        when _form = 'first' then if(not _md, 0, case when _kind = 3 then {bits('yyyyMMdd')}
            when _kind = 2 then if(_v rlike '^[0-9]', {bits('d MMM yyyy')}, {bits('MMM d, yyyy')})
            when _mark = '-' then {bits('yyyy-M-d')} when _mark = '/' then {bits('yyyy/M/d')} else 0 end)
        when _mark = '/' and _form = 'last' then if(_md, {bits('M/d/yyyy')}, 0) + if(_dm, {bits('d/M/yyyy')}, 0)
        when _mark = '/' then if(_md, {bits('M/d/yy')}, 0) + if(_dm, {bits('d/M/yy')}, 0)
        when _mark = '.' and _form = 'last' and _dm then {bits('d.M.yyyy')} else 0 end""")


def _in_calendar(month: str, day: str) -> str:
    """SQL: is it a day of ``_year``? The lengths of the months stand side by side, February with 29."""
    leap = "(_year % 4 = 0 and (_year % 100 <> 0 or _year % 400 = 0))"
    return f"""{month} between 1 and 12 and {day} between 1 and int(substr('312931303130313130313031', 2 * {month} - 1, 2))
        and ({day} < 29 or {month} <> 2 or {leap})"""
