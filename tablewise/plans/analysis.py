"""The whole job: profile and chart a table, clean it, profile and chart it again, compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewise.operators.profile import describe, missing_counts, shape, top_values
from tablewise.operators.roles import categorical_columns, role_table
from tablewise.plans.charts import Chart, chart_tables, recommended_charts, standard_charts
from tablewise.plans.cleaning import CleaningOptions, CleaningResult, clean_table
from tablewise.plans.compare import before_after
from tablewise.sources.tables import normalize_missing, require_rows


@dataclass
class Profile:
    shape: DataFrame
    roles: DataFrame
    numbers: DataFrame
    missing: DataFrame
    top_values: DataFrame | None      # None for a table without categories


@dataclass
class Analysis:
    original: Profile
    original_charts: dict[str, DataFrame]
    cleaning: CleaningResult
    cleaned: Profile
    cleaned_charts: dict[str, DataFrame]
    comparison: DataFrame


def profile_table(df: DataFrame) -> Profile:
    return Profile(shape(df), role_table(df), describe(df), missing_counts(df),
                   top_values(df) if categorical_columns(df) else None)


def analyze(df: DataFrame, recommendation: str | None = None, options: CleaningOptions | None = None,
            key: list[str] | None = None, exact_distinct: bool = True) -> Analysis:
    """Every result is a DataFrame; nothing larger than a profile is computed before it is asked for.

    ``exact_distinct=False`` compares distinct counts by sketch: exact ones shuffle the values of every column.
    """
    df = normalize_missing(require_rows(df))

    def plan(table: DataFrame) -> list[Chart]:
        return recommended_charts(table, recommendation) if recommendation else standard_charts(table)

    cleaning = clean_table(df, options)
    return Analysis(
        profile_table(df), chart_tables(df, plan(df), key), cleaning, profile_table(cleaning.cleaned),
        chart_tables(cleaning.cleaned, plan(cleaning.cleaned), key),
        before_after(df, cleaning.cleaned, exact_distinct),
    )
