"""Chart plans and the chart tables they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tablewise.constants import (
    STANDARD_COLOUR,
    STANDARD_GROUP,
    STANDARD_HEATMAP_MIN_NUMERIC,
    STANDARD_PIE,
    TITLE_BAR,
    TITLE_BOX,
    TITLE_BY,
    TITLE_HEATMAP,
    TITLE_HISTOGRAM,
    TITLE_LINE,
    TITLE_PIE,
    TITLE_SCATTER,
)
from tablewise.functions.dates import parse_date
from tablewise.operators import charts
from tablewise.operators.correlation import correlation
from tablewise.operators.dates import category_facts, date_columns
from tablewise.operators.profile import bar_values
from tablewise.operators.recommend import INDEX, chart_plan, chart_types, numbered_sections, table_facts
from tablewise.operators.roles import categorical_columns, column, datetime_columns, numeric_columns

MANIFEST_SCHEMA = "seq int, plot_type string, title string, x string, y string, group_col string"


@dataclass(frozen=True)
class Chart:
    """One chart of a plan: what is drawn, not how."""

    plot_type: str
    title: str
    x: str | None = None
    y: str | None = None
    group: str | None = None
    variant: str | None = None


def _chart(plot_type: str, title: str, x: str | None = None, y: str | None = None, by: str | None = None,
           **rest) -> Chart:
    text = title.format(x=x, y=y) + (TITLE_BY.format(group=by) if by else "")
    return Chart(plot_type, text, x, y, **rest)


def standard_charts(df: DataFrame) -> list[Chart]:
    """The default set: histogram, bar, donut, scatter, box, line, heatmap, as far as the columns allow."""
    numbers, categories = numeric_columns(df), categorical_columns(df)
    facts = category_facts(df, categories)
    distinct, dates = facts.distinct, datetime_columns(df) + list(facts.dates)

    def first_within(limits: tuple[int, int]) -> str | None:
        return next((c for c in categories if limits[0] <= distinct.get(c, limits[1] + 1) <= limits[1]), None)

    pie, colour, group = (first_within(limits) for limits in (STANDARD_PIE, STANDARD_COLOUR, STANDARD_GROUP))
    plan = []
    if numbers:
        plan.append(_chart("histogram", TITLE_HISTOGRAM, numbers[0]))
    if categories and distinct.get(categories[0], 1) > 0:
        plan.append(_chart("bar", TITLE_BAR, categories[0]))
    if pie:
        plan.append(_chart("pie", TITLE_PIE, pie, variant="plain"))
    if len(numbers) >= 2:
        plan.append(_chart("scatter", TITLE_SCATTER, numbers[0], numbers[1], by=colour, group=colour))
    if numbers and categories:
        plan.append(_chart("box", TITLE_BOX, colour, numbers[0], by=colour))
    if numbers and dates:
        plan.append(_chart("line", TITLE_LINE, dates[0], numbers[0], by=group, group=group))
    if len(numbers) >= STANDARD_HEATMAP_MIN_NUMERIC:
        plan.append(_chart("heatmap", TITLE_HEATMAP))
    return plan


def manifest(df: DataFrame, plan: list[Chart] | None = None) -> DataFrame:
    """seq, plot_type, title, x, y, group_col of a plan; by default of the standard set."""
    plan = standard_charts(df) if plan is None else plan
    rows = [(i, c.plot_type, c.title, c.x, c.y, c.group) for i, c in enumerate(plan, start=1)]
    return df.sparkSession.createDataFrame(rows, MANIFEST_SCHEMA)


def _time_axis(df: DataFrame, name: str) -> Column | None:
    """A date column, real or text, as an expression; None for any other column."""
    if name in datetime_columns(df):
        return column(name)
    formats = date_columns(df, [name]) if name in categorical_columns(df) else {}
    return parse_date(column(name), formats[name]) if name in formats else None


def _area_table(df: DataFrame, chart: Chart, key: list[str] | None) -> DataFrame:
    if chart.x == INDEX and INDEX not in df.columns:
        at, unit = None, None
    else:
        time = _time_axis(df, chart.x)
        at, unit = (chart.x, None) if time is None else (time, "day")
    key = key or df.columns
    if chart.variant == "stacked":
        return charts.area_stacked(df, at, chart.y, chart.group, unit, key)
    if chart.variant == "share":
        return charts.area_share(df, at, chart.y, chart.group, unit, key)
    return charts.area(df, at, chart.y, unit, key)


def _line_table(df: DataFrame, chart: Chart, key: list[str] | None, binned: bool) -> DataFrame:
    if chart.x == INDEX and INDEX not in df.columns:
        return charts.line_series(df, None, chart.y, chart.group, key=key or df.columns)
    time = _time_axis(df, chart.x)
    if binned and time is not None:
        return charts.line_bucketed(df, time, chart.y, chart.group)
    return charts.line_series(df, chart.x if time is None else time, chart.y, chart.group)


def chart_table(df: DataFrame, chart: Chart, key: list[str] | None = None, binned: bool = False) -> DataFrame:
    """The table behind one chart. ``binned`` gives the small form of a scatter, a bubble and a line over time in
    place of all points."""
    kind = chart.plot_type
    if kind == "histogram":
        return charts.histogram(df, chart.x)
    if kind == "bar":
        return charts.crosstab(df, chart.x, chart.group) if chart.group else bar_values(df, chart.x)
    if kind == "pie":
        return charts.composition(df, chart.x, fold=chart.variant != "plain")
    if kind == "scatter":
        if binned:
            return charts.scatter_density(df, chart.x, chart.y)
        return charts.scatter_points(df, chart.x, chart.y, chart.group)
    if kind == "box":
        return charts.box_stats(df, chart.y, chart.x)
    if kind == "violin":
        return charts.violin_density(df, chart.y, chart.x)
    if kind == "line":
        return _line_table(df, chart, key, binned)
    if kind == "area":
        return _area_table(df, chart, key)
    if kind == "heatmap":
        return correlation(df)
    if kind == "bubble":
        return charts.bubble_bins(df, colour=chart.group) if binned else charts.bubble_points(df, colour=chart.group)
    if kind == "radar":
        return charts.radar(df, chart.group, chart.x.split(", "))
    if kind == "treemap":
        return charts.treemap(df, chart.x.split(" > "), chart.y)
    raise ValueError(f"unknown chart {kind!r}")


def recommended_charts(df: DataFrame, text: str) -> list[Chart]:
    """The plan of one written recommendation about ``df``; the standard set when it names no chart."""
    texts = df.sparkSession.createDataFrame([(0, text)], "doc_id long, text string")
    rows = chart_plan(chart_types(numbered_sections(texts)), table_facts(df)).orderBy("section").collect()
    plan = [
        Chart(r["plot_type"], f"{r['plot_type'].capitalize()} of {r['y'] or r['x'] or 'the table'}",
              r["x"], r["y"], r["group_col"], r["variant"])
        for r in rows
    ]
    return plan or standard_charts(df)


def chart_tables(df: DataFrame, plan: list[Chart] | None = None, key: list[str] | None = None, binned: bool = False
                 ) -> dict[str, DataFrame]:
    """Name -> table for every chart of a plan; by default the standard set."""
    plan = standard_charts(df) if plan is None else plan
    return {f"{i}_{c.plot_type}": chart_table(df, c, key, binned) for i, c in enumerate(plan, start=1)}
