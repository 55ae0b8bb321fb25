"""The profile of a table before and after cleaning, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.profile import column_profile


def before_after(before: DataFrame, after: DataFrame, exact: bool = True) -> DataFrame:
    """column_name and each statistic before and after, for columns present on either side. With ``exact=False`` each
    column of a side is read once."""
    sides = []
    for name, df in (("before", before), ("after", after)):
        profile = column_profile(df, exact)
        sides.append(profile.select("column_name", *[
            F.col(c).alias(f"{c}_{name}") for c in profile.columns if c != "column_name"
        ]))
    joined = sides[0].join(sides[1], "column_name", "full")
    order = [f"{c}_{side}" for c in ("n_missing", "n_unique", "mean", "std", "min", "max")
             for side in ("before", "after")]
    return joined.select("column_name", *order)
