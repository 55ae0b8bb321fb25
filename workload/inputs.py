"""Input tables of the queries: the given tables, and untidy tables derived from all of their rows.

Each derived table is written twice, as a DataFrame and as SQL text for the check, with equal rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- lineitem with missing values, extreme prices, untidy text and copies -------------------------

_DIRTY = {
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_linenumber": "l_linenumber",
    "l_quantity": "case when (l_orderkey + l_linenumber) % 11 = 0 then null else l_quantity end",
    "l_extendedprice": "case when l_orderkey % 997 = 0 then l_extendedprice * 50 else l_extendedprice end",
    "l_returnflag": "case when l_orderkey % 13 = 0 then null else l_returnflag end",
    "l_linestatus": "case when l_linenumber = 2 then concat('  ', l_linestatus, ' ') "
                    "when l_linenumber = 3 then lower(l_linestatus) else l_linestatus end",
}
DIRTY_COLUMNS = [*_DIRTY, "note"]


def dirty_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").selectExpr(
        *[f"{e} as {c}" for c, e in _DIRTY.items()], "cast(null as string) as note",
        "explode(sequence(1, if(l_orderkey % 101 = 0, 2, 1))) as copy",
    )
    return rows.drop("copy")


DIRTY_SQL = f"""dirty_base as (
  select {', '.join(f'{e} as {c}' for c, e in _DIRTY.items())}, cast(null as varchar) as note from lineitem),
dirty as (select * from dirty_base union all select * from dirty_base where l_orderkey % 101 = 0)"""


# --- order dates as text --------------------------------------------------------------------------


def _date_text(fmt: str, every: int) -> str:
    return (f"case when o_orderkey % {every} = 0 then null when o_orderkey % 50 = 1 then 'junk' else {fmt} end")


def dirty_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = "date_format(o_orderdate, 'M/d/yyyy')"
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{_date_text(text, 7)} as often", f"{_date_text(text, 4)} as seldom"
    )


_STRFTIME = "strftime(o_orderdate, '%-m/%-d/%Y')"
DATES_SQL = f"""dates as (select o_orderkey, {_date_text(_STRFTIME, 7)} as often,
  {_date_text(_STRFTIME, 4)} as seldom from orders)"""


# --- part with untidy categories ------------------------------------------------------------------

_UNTIDY = {
    "p_partkey": "p_partkey",
    "p_name": "p_name",
    "p_type": "case when p_partkey % 3 = 0 then concat('  ', p_type, ' ') else p_type end",
    "p_brand": "case when p_partkey % 4 = 0 then lower(p_brand) else p_brand end",
}


def untidy_part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(*[f"{e} as {c}" for c, e in _UNTIDY.items()])


UNTIDY_SQL = f"untidy as (select {', '.join(f'{e} as {c}' for c, e in _UNTIDY.items())} from part)"


# --- lineitem as a table somebody wants charts of -------------------------------------------------

SALES_COLUMNS = {
    "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus",
    "tax_bucket": "concat('tax_', cast(cast(round(l_tax * 100) as int) as {text}))",
    "ship_text": "{ship}", "l_shipdate": "l_shipdate",
}


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*[
        e.format(text="string", ship="date_format(l_shipdate, 'M/d/yyyy')") + f" as {c}"
        for c, e in SALES_COLUMNS.items()
    ])


SALES_SQL = "sales as (select " + ", ".join(
    e.format(text="varchar", ship="strftime(l_shipdate, '%-m/%-d/%Y')") + f" as {c}"
    for c, e in SALES_COLUMNS.items()
) + " from lineitem)"


# --- written recommendations, one text per part ---------------------------------------------------

_PHRASES = (
    "Histogram of l_extendedprice",
    "Bar chart of tax_bucket by l_returnflag",
    "Pie chart of tax_bucket and ship_text",
    "Scatter of l_quantity and l_extendedprice coloured by l_linestatus",
    "Boxplot of l_discount for each l_returnflag",
    "Trend of l_quantity over l_shipdate for l_linestatus",
    "Stacked area chart of l_extendedprice by l_returnflag",
    "Heat map of all numbers",
    "Bubble chart with l_returnflag",
    "Violin of l_quantity by ship_text",
    "Radar chart of the numbers by tax_bucket",
    "Treemap of l_returnflag, l_linestatus sized by l_quantity",
    "Area graph of l_discount",
    "Line graph of L_QUANTITY by ship_text",
    "A map of nothing in particular",
)


def _recommendation_lines(newline: str) -> str:
    phrase = " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PHRASES))
    lines = (
        "concat('Charts for ', p_name)",
        f"concat('  1. ', case p_partkey % {len(_PHRASES)} {phrase} end)",
        "concat('   as seen in ', p_brand, '  ')",
        "''",
        "'2. Bar chart of l_returnflag by l_linestatus'",
        "'10. is no section of its own'",
        "'3. short'",
        "'4.'",
        "concat('5. Relationship of l_discount, l_extendedprice and ', p_type)",
    )
    return f", {newline}, ".join(lines)


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    newline = "'\\n'"
    return table(spark, folder, "part").selectExpr(
        "p_partkey as doc_id", f"concat({_recommendation_lines(newline)}) as text"
    )


RECOMMENDATIONS_SQL = f"""texts as (
  select p_partkey as doc_id, concat({_recommendation_lines('chr(10)')}) as text from part)"""


# --- orders as a CSV file would hold them ---------------------------------------------------------


def csv_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as o_orderkey",
        "if(o_orderkey % 9 = 0, 'NA', cast(o_custkey as string)) as o_custkey",
        "if(o_orderkey % 13 = 0, 'n/a', o_orderstatus) as o_orderstatus",
        "if(o_orderkey % 11 = 0, 'NaN', cast(o_totalprice as string)) as o_totalprice",
        "date_format(o_orderdate, 'M/d/yyyy') as o_orderdate",
        "if(o_orderkey % 10 = 0, concat('say \"', o_orderpriority, '\", please '), o_orderpriority) as o_orderpriority",
        "if(o_orderkey % 2 = 0, 'True', 'false') as even",
    )


CSV_SQL = f"""select o_orderkey,
  case when o_orderkey % 9 = 0 then null else cast(o_custkey as double) end as o_custkey,
  case when o_orderkey % 13 = 0 then null else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 11 = 0 then null else o_totalprice end as o_totalprice,
  {_STRFTIME} as o_orderdate,
  case when o_orderkey % 10 = 0 then concat('say "', o_orderpriority, '", please ') else o_orderpriority end
    as o_orderpriority,
  o_orderkey % 2 = 0 as even
from orders"""
