"""Profile, clean and chart tables of any size with PySpark."""

from tablewise.plans.analysis import Analysis, Profile, analyze, profile_table
from tablewise.plans.charts import (
    Chart,
    chart_table,
    chart_tables,
    manifest,
    recommended_charts,
    standard_charts,
)
from tablewise.plans.cleaning import CleaningModel, CleaningOptions, CleaningResult, clean_table
from tablewise.plans.compare import before_after
from tablewise.sources.tables import (
    convert_types,
    normalize_missing,
    read_csv,
    require_rows,
    write_csv,
    write_table,
)

__all__ = [
    "Analysis", "Chart", "CleaningModel", "CleaningOptions", "CleaningResult", "Profile", "analyze",
    "before_after", "chart_table", "chart_tables", "clean_table", "convert_types", "manifest",
    "normalize_missing", "profile_table", "read_csv", "recommended_charts", "require_rows",
    "standard_charts", "write_csv", "write_table",
]
