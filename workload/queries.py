"""One query per operator, each over whole tables. Doubles are rounded, as sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.operators import charts, clean, dates, ordering, profile, quantiles, recommend, roles
from tablewise.operators.correlation import correlation
from tablewise.plans.charts import chart_tables, manifest, recommended_charts
from tablewise.plans.cleaning import CleaningOptions, clean_table
from tablewise.plans.compare import before_after
from tablewise.sources.staging import new_path
from tablewise.sources.tables import convert_types, normalize_missing, read_csv, write_csv
from workload.inputs import (
    csv_orders,
    dirty_dates,
    dirty_lineitem,
    recommendations,
    sales,
    table,
    untidy_part,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[f"q_{build.__name__.rstrip('_')}"] = build
    return build


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# --- sources --------------------------------------------------------------------------------------


@query
def csv_ingest(spark, folder):
    path = new_path(spark, "orders-csv")
    write_csv(csv_orders(spark, folder), path)
    return read_csv(spark, path)


@query
def csv_long_ids(spark, folder):
    """Whole numbers of 19 digits stay whole numbers."""
    path = new_path(spark, "long-ids-csv")
    orders = table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey + 1790000000000000000 as string) as id", "o_orderpriority")
    write_csv(orders, path)
    return read_csv(spark, path)


@query
def csv_multiline(spark, folder):
    path = new_path(spark, "multiline-csv")
    orders = table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as id", "concat(o_orderstatus, '\\n', '\"', o_orderpriority, '\"') as note")
    write_csv(orders, path)
    return read_csv(spark, path, multi_line=True)


@query
def csv_stray_quotes(spark, folder):
    """Inch marks in fields without quotes."""
    path = new_path(spark, "stray-quotes-csv")
    orders = table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as id", "concat(o_orderkey % 40, '\" pipe') as size",
        "if(o_orderkey % 3 = 0, concat(o_orderpriority, ' 5\" x 3\"'), o_orderstatus) as note")
    write_csv(orders, path, quote="")
    return read_csv(spark, path)


@query
def normalize_missing_(spark, folder):
    untidy = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "if(l_orderkey % 5 = 0, double('NaN'), l_quantity) as l_quantity",
        "case l_orderkey % 7 when 0 then 'NA' when 1 then '<NA>' when 2 then 'null' else l_returnflag end as l_returnflag",
        "if(l_orderkey % 3 = 0, '', l_linestatus) as l_linestatus",
    )
    return normalize_missing(untidy)


@query
def preview(spark, folder):
    return profile.preview(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# --- roles, dates, filters ------------------------------------------------------------------------


@query
def column_roles(spark, folder):
    return roles.role_table(table(spark, folder, "lineitem"))


@query
def date_sample_detect(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return dates.detect_by_sample(dirty_dates(spark, folder).join(orders, "o_orderkey"), ["o_orderkey"])


@query
def date_rate_detect(spark, folder):
    return rounded(dates.detect_by_rate(dirty_dates(spark, folder)))


@query
def date_materialize(spark, folder):
    return dates.materialize_dates(dirty_dates(spark, folder))


@query
def date_formats(spark, folder):
    """One column for each of the forms that exports use most."""
    texts = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as iso_zone",
        "date_format(o_orderdate, 'M/d/yyyy h:mm a') as us_time", "date_format(o_orderdate, 'M/d/yy') as short_year",
        "date_format(o_orderdate, 'yyyyMMdd') as compact", "upper(date_format(o_orderdate, 'MMMM d, yyyy')) as name",
        "date_format(o_orderdate, 'd.M.yyyy') as dotted")
    return dates.materialize_dates(texts)


@query
def convert_types_(spark, folder):
    texts = dirty_dates(spark, folder).selectExpr(
        "*", "if(o_orderkey % 9 = 0, 'x', cast(o_orderkey / 4 as string)) as mostly_number"
    )
    return convert_types(texts)


@query
def row_index(spark, folder):
    events = table(spark, folder, "events").selectExpr("event_id as key", "value as y")
    return ordering.row_index(events, ["key"])


@query
def topk_member_filter(spark, folder):
    return ordering.keep_top_categories(table(spark, folder, "part"), "p_brand", 6)


@query
def dropna_key(spark, folder):
    return ordering.drop_missing_key(dirty_dates(spark, folder), ["often"])


# --- profile --------------------------------------------------------------------------------------


@query
def shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query
def describe(spark, folder):
    return rounded(profile.describe(table(spark, folder, "lineitem")), 4)


@query
def describe_missing(spark, folder):
    return rounded(profile.describe(dirty_lineitem(spark, folder)), 4)


@query
def short_stats(spark, folder):
    return profile.short_stats(table(spark, folder, "lineitem"))


@query
def topk_values(spark, folder):
    return profile.top_values(table(spark, folder, "part"))


@query
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "part"))


@query
def topk_unique_text(spark, folder):
    """The most frequent values of a text that is nearly unique: only candidates of a summary are counted."""
    return profile.top_values(table(spark, folder, "lineitem").selectExpr(
        "if(l_orderkey % 5 = 0, concat('standard ', l_linenumber), "
        "concat('note ', l_orderkey, '-', l_linenumber, '-', l_partkey)) as note"), k=4)


@query
def bar_top10(spark, folder):
    return profile.bar_values(table(spark, folder, "part"), "p_brand")


@query
def missing_counts(spark, folder):
    return profile.missing_counts(dirty_lineitem(spark, folder))


@query
def missing_positive(spark, folder):
    return profile.missing_counts(dirty_lineitem(spark, folder), only_positive=True)


@query
def column_info(spark, folder):
    return profile.column_info(dirty_lineitem(spark, folder))


@query
def nunique(spark, folder):
    return profile.distinct_counts(table(spark, folder, "customer"))


@query
def mode(spark, folder):
    return profile.modes(table(spark, folder, "orders"))


@query
def quantiles_(spark, folder):
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    return rounded(quantiles.quantile_table(table(spark, folder, "lineitem"), numbers, [0.25, 0.5, 0.75]))


@query
def quantiles_searched(spark, folder):
    """The same by the search that a large table takes, forced to narrow its brackets twice."""
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    return rounded(quantiles.quantile_table(
        table(spark, folder, "lineitem"), numbers, [0.25, 0.5, 0.75], direct_rows=0, budget=1000
    ))


@query
def quantiles_hot_key(spark, folder):
    """64-bit keys beyond what a double can tell apart, a third of them equal, by the search. Neighbouring keys lie a
    million apart; with each quantile, to a hundred thousand, go the numbers of keys below it and up to it."""
    keys = table(spark, folder, "lineitem").selectExpr(
        "if(l_orderkey % 3 = 0, 1152921504606847677L, l_orderkey * 1000003L + 1152921504606846976L) as key")
    found = quantiles.quantile_table(keys, ["key"], [0.1, 0.5, 0.9], direct_rows=0, budget=1000)
    wanted = [(r["q"], r["value"]) for r in found.collect()]       # three quantiles
    key = F.col("key").cast("double")
    ranks = keys.agg(*[a.alias(f"{name}{i}") for i, (_, v) in enumerate(wanted) for name, a in (
        ("below", F.count_if(key < v)), ("up_to", F.count_if(key <= v)))])
    cells = ", ".join(f"double({q!r}), round(double({v!r}) / 1e5), below{i}, up_to{i}" for i, (q, v) in enumerate(wanted))
    return ranks.selectExpr(f"stack({len(wanted)}, {cells}) as (q, value, n_below, n_up_to)")


@query
def group_means(spark, folder):
    features = ["l_quantity", "l_extendedprice"]
    return rounded(profile.group_means(dirty_lineitem(spark, folder), "l_returnflag", features), 4)


@query
def correlation_(spark, folder):
    return rounded(correlation(table(spark, folder, "lineitem")))


@query
def correlation_missing(spark, folder):
    return rounded(correlation(dirty_lineitem(spark, folder)))


@query
def correlation_constant(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_linenumber", "same"]
    return rounded(correlation(dirty_lineitem(spark, folder).withColumn("same", F.lit(3.5)), columns))


# --- cleaning -------------------------------------------------------------------------------------


@query
def impute_median(spark, folder):
    return clean.impute_median(dirty_lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity"))


@query
def impute_mode(spark, folder):
    return clean.impute_mode(dirty_lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_returnflag"))


@query
def impute_unknown(spark, folder):
    return clean.impute_mode(dirty_lineitem(spark, folder).select("l_orderkey", "l_linenumber", "note"))


@query
def dedupe(spark, folder):
    return clean.drop_duplicate_rows(dirty_lineitem(spark, folder))


@query
def dedupe_documents(spark, folder):
    return clean.drop_duplicate_wide_rows(table(spark, folder, "documents").drop("doc_id"))


@query
def outlier_bounds(spark, folder):
    return rounded(clean.outlier_bounds(table(spark, folder, "events")))


@query
def outlier_counts(spark, folder):
    documents = table(spark, folder, "documents").select("n_chars")
    return clean.outlier_counts(table(spark, folder, "events")).unionByName(clean.outlier_counts(documents))


@query
def cap_outliers(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(clean.cap_outliers(events))


@query
def text_eligibility(spark, folder):
    return clean.text_eligibility(untidy_part(spark, folder))


@query
def strip_text(spark, folder):
    return clean.strip_text(untidy_part(spark, folder))


@query
def title_case(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 2 = 0, concat(' ', o_orderpriority), lower(o_orderpriority)) as o_orderpriority",
        "lower(o_orderstatus) as o_orderstatus",
    )
    return clean.title_text(orders)


@query
def cleaning_actions(spark, folder):
    return clean_table(dirty_lineitem(spark, folder)).action_log()


@query
def cleaning_issues(spark, folder):
    return clean_table(dirty_lineitem(spark, folder)).issue_table()


@query
def cleaning_report(spark, folder):
    return clean_table(dirty_lineitem(spark, folder)).report()


@query
def clean_table_(spark, folder):
    return rounded(clean_table(dirty_lineitem(spark, folder)).cleaned)


SEARCHED = {"direct_rows": 0, "budget": 1000}


@query
def clean_table_searched(spark, folder):
    """The same with every quantile searched for, as in a large table."""
    options = CleaningOptions(quantile_limits=SEARCHED)
    return rounded(clean_table(dirty_lineitem(spark, folder), options).cleaned)


@query
def model_transform(spark, folder):
    """Fitted on the orders with an even key, applied to the others."""
    numbers = dirty_lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = clean_table(numbers.where("l_orderkey % 2 = 0"), CleaningOptions(reusable=True)).model
    return rounded(model.transform(numbers.where("l_orderkey % 2 = 1")))


@query
def before_after_texts(spark, folder):
    """A table without numbers."""
    texts = table(spark, folder, "documents").select("text", "lang", "source")
    return before_after(texts, clean.drop_duplicate_wide_rows(texts))


@query
def before_after_(spark, folder):
    dirty = dirty_lineitem(spark, folder)
    return rounded(before_after(dirty, clean_table(dirty).cleaned), 4)


# --- charts ---------------------------------------------------------------------------------------


@query
def histogram(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 30))


@query
def crosstab(spark, folder):
    return charts.crosstab(dirty_lineitem(spark, folder), "l_linestatus", "l_returnflag")


@query
def odd_names(spark, folder):
    """Column names with a dot, a space and a back tick."""
    odd = dirty_lineitem(spark, folder).withColumnsRenamed({"l_linestatus": "l.line`status", "l_returnflag": "l returnflag"})
    return charts.crosstab(odd, "l.line`status", "l returnflag")


@query
def composition(spark, folder):
    return rounded(charts.composition(table(spark, folder, "part"), "p_type"))


@query
def composition_other(spark, folder):
    return rounded(charts.composition(sales(spark, folder), "tax_bucket"))


@query
def composition_plain(spark, folder):
    return rounded(charts.composition(sales(spark, folder), "tax_bucket", fold=False))


@query
def scatter_points(spark, folder):
    return charts.scatter_points(dirty_lineitem(spark, folder), "l_quantity", "l_extendedprice", "l_returnflag")


@query
def scatter_density(spark, folder):
    return charts.scatter_density(dirty_lineitem(spark, folder), "l_quantity", "l_extendedprice")


@query
def scatter_quadtree(spark, folder):
    return rounded(charts.density_quadtree(dirty_lineitem(spark, folder), "l_quantity", "l_extendedprice", "l_partkey", levels=7))


@query
def scatter_quadtree_view(spark, folder):
    """What a chart reads when a user zooms into one node."""
    tree = charts.density_quadtree(table(spark, folder, "lineitem"), "l_partkey", "l_extendedprice", levels=8)
    return charts.quadtree_view(tree, 2, 1, 2, detail=5).drop("mean_size")


@query
def scatter_refline(spark, folder):
    return charts.scatter_reference_line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query
def box_stats(spark, folder):
    return rounded(charts.box_stats(dirty_lineitem(spark, folder), "l_extendedprice", "l_returnflag"))


@query
def box_stats_searched(spark, folder):
    dirty = dirty_lineitem(spark, folder)
    return rounded(charts.box_stats(dirty, "l_extendedprice", "l_returnflag", **SEARCHED))


@query
def box_stats_ungrouped(spark, folder):
    return rounded(charts.box_stats(table(spark, folder, "events"), "value"))


@query
def line_series(spark, folder):
    return charts.line_series(table(spark, folder, "events"), "ts", "value", "event_type")


@query
def line_bucketed(spark, folder):
    return rounded(charts.line_bucketed(table(spark, folder, "events"), "ts", "value", "event_type"))


@query
def line_m4(spark, folder):
    return charts.line_m4(table(spark, folder, "events"), "ts", "value", "event_type", width=200)


@query
def line_m4_positions(spark, folder):
    """Without an x: positions by the key, and 300 pixels."""
    return charts.line_m4(table(spark, folder, "lineitem"), None, "l_extendedprice", width=300,
                          key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query
def area(spark, folder):
    return rounded(charts.area(table(spark, folder, "events"), "ts", "value"), 4)


@query
def area_stacked(spark, folder):
    return rounded(charts.area_stacked(table(spark, folder, "events"), "ts", "value", "event_type"), 4)


@query
def area_share(spark, folder):
    return rounded(charts.area_share(table(spark, folder, "events"), "ts", "value", "event_type"), 4)


@query
def bubble_points(spark, folder):
    return rounded(charts.bubble_points(table(spark, folder, "events"), colour="event_type"), 6)


@query
def bubble_bins(spark, folder):
    return rounded(charts.bubble_bins(table(spark, folder, "lineitem"), "l_quantity", "l_tax", "l_extendedprice",
                                      "l_returnflag"))


@query
def violin_density(spark, folder):
    density = charts.violin_density(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag")
    return density.select("group_value", F.round("grid", 4).alias("grid"), F.round("density", 10).alias("density"))


@query
def radar(spark, folder):
    part = table(spark, folder, "part")
    return rounded(charts.radar(part, "p_brand", ["p_partkey", "p_size", "p_retailprice"]))


@query
def treemap(spark, folder):
    return rounded(charts.treemap(table(spark, folder, "part"), ["p_type", "p_brand"], "p_retailprice"), 4)


@query
def standard_manifest(spark, folder):
    return manifest(table(spark, folder, "events"))


#: What a row of a chart's table says, as (key columns, value column)
_LONG = {"histogram": (["bin"], "n"), "bar": (["value"], "n"), "pie": (["value"], "pct"), "box": (["group_value"], "median"),
         "scatter": (["cast(x as bigint)", "colour"], "y"), "heatmap": (["col_x", "col_y"], "r"),
         "line": (["date_format(x, 'yyyy-MM-dd HH:mm:ss')", "group_value"], "y")}


def _long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """seq, plot_type, key, value: all tables of a chart plan in one."""
    parts = []
    for name, df in tables.items():
        seq, kind = name.split("_", 1)
        keys, value = _LONG[kind]
        parts.append(df.selectExpr(f"{seq} as seq", f"'{kind}' as plot_type", f"concat_ws('|', {', '.join(keys)}) as key",
                                   f"round(cast({value} as double), 4) as value"))
    return reduce(DataFrame.union, parts)


@query
def standard_charts(spark, folder):
    """Every table of the standard set."""
    return _long_form(chart_tables(table(spark, folder, "events")))


@query
def recommended_charts_(spark, folder):
    """A written recommendation down to the tables of its charts."""
    df = sales(spark, folder)
    text = ("Look at this:\n1. Histogram of l_extendedprice\n2. Pie chart of tax_bucket\n"
            "3. Boxplot of l_quantity for each l_returnflag\n4. nothing to draw here")
    return _long_form(chart_tables(df, recommended_charts(df, text)))


# --- written recommendations ----------------------------------------------------------------------


@query
def numbered_sections(spark, folder):
    return recommend.numbered_sections(recommendations(spark, folder))


@query
def chart_type(spark, folder):
    return recommend.chart_types(recommend.numbered_sections(recommendations(spark, folder)))


@query
def column_mentions(spark, folder):
    facts = recommend.table_facts(sales(spark, folder))
    return recommend.column_mentions(recommend.numbered_sections(recommendations(spark, folder)), facts)


@query
def chart_plan(spark, folder):
    facts = recommend.table_facts(sales(spark, folder))
    sections = recommend.numbered_sections(recommendations(spark, folder))
    return recommend.chart_plan(recommend.chart_types(sections), facts)
