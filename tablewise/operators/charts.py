"""The tables behind charts: small aggregates of a table of any size.

Where the drawing library would aggregate raw rows, the aggregate is defined here. Minimum, maximum and
group lists are fitted first and enter as literals, so the second pass is one grouped scan. The point
tables (scatter, bubble, line series) are projections of all rows; for large tables use the density and
bucketed forms beside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablewise.constants import (
    CATEGORY_MAX_DISTINCT,
    CROSSTAB_MAX_GROUPS,
    CROSSTAB_MAX_VALUES,
    PIE_FOLD_ABOVE,
    PIE_KEEP,
    PIE_MAX_DISTINCT,
    RADAR_TOP_CATEGORIES,
)
from tablewise.operators.ordering import row_index, top_categories
from tablewise.operators.profile import QUARTILES
from tablewise.operators.quantiles import column_quantiles
from tablewise.operators.roles import column, numeric_columns, with_values

ALL = "all"          # the group of a chart without groups
OTHER = "Other"
BOX_SCHEMA = ("group_value string, n long, q1 double, median double, q3 double, whisker_lo double, "
              "whisker_hi double, n_outliers long, notch_lo double, notch_hi double")


class TooManyCategories(ValueError):
    """A category has more values than its chart allows."""


def category_values(df: DataFrame, name: str, most: int) -> list:
    """The distinct values, sorted; raises when there are more than ``most`` (reads at most one more)."""
    values = df.where(column(name).isNotNull()).select(column(name).alias("v")).distinct().limit(most + 1)
    found = sorted(r["v"] for r in values.collect())
    if len(found) > most:
        raise TooManyCategories(f"{name} has more than {most} values")
    return found


def _range(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    row = df.agg(*[f(column(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]


def _bin(value: Column, low: float, high: float, nbins: int) -> Column:
    """Equal-width bins from 1; the maximum belongs to the last, a constant to the first."""
    if high == low:
        return F.lit(1)
    width = (high - low) / nbins
    return F.least(F.floor((value - low) / width) + 1, F.lit(nbins)).cast("int")


# --- one column ---------------------------------------------------------------------------------


def histogram(df: DataFrame, name: str, nbins: int = 30) -> DataFrame:
    """column_name, bin, lo, hi, n for the bins that hold a value."""
    [(low, high)] = _range(df, name)
    value = column(name).cast("double")
    if low is None:
        low = high = 0.0
    width = (high - low) / nbins
    counts = df.where(value.isNotNull()).groupBy(_bin(value, low, high, nbins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        F.lit(name).alias("column_name"), "bin",
        (low + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
        (low + F.col("bin") * F.lit(width)).alias("hi"), "n",
    )


def composition(df: DataFrame, name: str, fold: bool = True) -> DataFrame:
    """value, n, pct for a column with at most 10 values. With ``fold`` and more than 8 values the
    seven most frequent are kept and the rest is summed as 'Other'."""
    category_values(df, name, PIE_MAX_DISTINCT)
    value = column(name).cast("string")
    # At most ten rows from here on, so the windows over all of them are harmless.
    counts = df.where(column(name).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if fold:
        ranked = counts.select(
            "value", "n",
            F.row_number().over(W.orderBy(F.desc("n"), "value")).alias("rnk"),
            F.count(F.lit(1)).over(W.partitionBy()).alias("n_values"),
        )
        kept = (F.col("n_values") <= PIE_FOLD_ABOVE) | (F.col("rnk") <= PIE_KEEP)
        counts = ranked.groupBy(F.when(kept, F.col("value")).otherwise(OTHER).alias("value"), kept).agg(
            F.sum("n").alias("n")
        ).select("value", "n")
    return counts.withColumn("pct", F.col("n") / F.sum("n").over(W.partitionBy()))


def crosstab(df: DataFrame, name: str, group: str) -> DataFrame:
    """value and one count column per group value; rows with either missing are left out."""
    category_values(df, name, CROSSTAB_MAX_VALUES)
    groups = category_values(df, group, CROSSTAB_MAX_GROUPS)
    present = with_values(df, [name, group]).select(column(name).alias("value"), column(group).alias("group_value"))
    counts = present.groupBy("value").pivot("group_value", groups).agg(F.count(F.lit(1)))
    return counts.select("value", *[F.coalesce(column(c), F.lit(0)).alias(c) for c in counts.columns[1:]])


# --- two and three numbers ----------------------------------------------------------------------


def scatter_points(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """x, y, colour: every row that has both numbers."""
    group = column(colour).cast("string") if colour else F.lit(None).cast("string")
    return with_values(df, [x, y]).select(
        column(x).cast("double").alias("x"), column(y).cast("double").alias("y"), group.alias("colour")
    )


def scatter_density(df: DataFrame, x: str, y: str, nbins: int = 40) -> DataFrame:
    """xbin, ybin, n: at most nbins squared rows in place of the points."""
    present = with_values(df, [x, y])
    (x0, x1), (y0, y1) = _range(present, x, y)
    if x0 is None:
        x0 = x1 = y0 = y1 = 0.0
    return present.groupBy(
        _bin(column(x).cast("double"), x0, x1, nbins).alias("xbin"),
        _bin(column(y).cast("double"), y0, y1, nbins).alias("ybin"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _spread_bits(value: Column) -> Column:
    """The 16 low bits of ``value`` moved to the even places."""
    value = value.cast("bigint")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def density_quadtree(df: DataFrame, x: str, y: str, size: str | None = None, levels: int = 8) -> DataFrame:
    """level, z, xbin, ybin, n, mean_size: the counts of every node of a quadtree over the points, for charts that zoom.

    Level k cuts both ranges into 2^k bins (from 0); z interleaves the bits of ybin and xbin, so that the nodes below a
    node are a range of z. Rows are counted once, at the finest level; every coarser one is summed from those counts by
    the prefix of z, so that the work after the scan depends on the 4^levels cells at most (``levels`` up to 16).
    ``mean_size`` is the mean of ``size``, NULL without it. Rows without x or y are left out; a constant has bin 0.
    """
    if not 0 <= levels <= 16:
        raise ValueError("levels must be between 0 and 16")
    points = with_values(df, [x, y])
    (x0, x1), (y0, y1) = _range(points, x, y)
    if x0 is None:
        x0 = x1 = y0 = y1 = 0.0
    xbin, ybin = ((_bin(column(c).cast("double"), lo, hi, 1 << levels) - 1)
                  for c, lo, hi in ((x, x0, x1), (y, y0, y1)))
    z = _spread_bits(xbin).bitwiseOR(F.shiftleft(_spread_bits(ybin), 1))
    value = column(size).cast("double") if size else F.lit(None).cast("double")
    cells = points.select(z.alias("z"), xbin.alias("xbin"), ybin.alias("ybin"), value.alias("s")).groupBy("z", "xbin", "ybin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.count("s").alias("sized"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = f"({levels} - level)"
    nodes = cells.select("*", level).groupBy("level", F.expr(f"shiftright(z, 2 * {up})").alias("z"),
                                             F.expr(f"shiftright(xbin, {up})").alias("xbin"),
                                             F.expr(f"shiftright(ybin, {up})").alias("ybin"))
    return nodes.agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("sized")).alias("mean_size"))


def quadtree_view(tree: DataFrame, tile_level: int, tile_x: int, tile_y: int, detail: int = 5) -> DataFrame:
    """The nodes ``detail`` levels below one node of ``density_quadtree``: one range of z, which reaches the scan of a
    stored tree."""
    z = sum((tile_x >> i & 1) << 2 * i | (tile_y >> i & 1) << 2 * i + 1 for i in range(tile_level))
    return tree.where((F.col("level") == tile_level + detail) & (F.col("z") >= z << 2 * detail)
                      & (F.col("z") < z + 1 << 2 * detail))


def scatter_reference_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """x0, y0, x1, y1: from the two minima to the two maxima (not a regression)."""
    cx, cy = column(x).cast("double"), column(y).cast("double")
    return df.agg(F.min(cx).alias("x0"), F.min(cy).alias("y0"), F.max(cx).alias("x1"), F.max(cy).alias("y1"))


def bubble_points(df: DataFrame, x: str | None = None, y: str | None = None, size: str | None = None,
                  colour: str | None = None) -> DataFrame:
    """x, y, colour, size (as a share of the largest). By default the first three numbers."""
    numbers = numeric_columns(df)
    x, y, size = x or numbers[0], y or numbers[1], size or numbers[2]
    largest = df.agg(F.max(column(size).cast("double"))).first()[0]
    points = with_values(df, [x, y, size])
    group = column(colour).cast("string") if colour else F.lit(None).cast("string")
    return points.select(
        column(x).cast("double").alias("x"), column(y).cast("double").alias("y"), group.alias("colour"),
        F.try_divide(column(size).cast("double"), F.lit(largest)).alias("size"),
    )


def bubble_bins(df: DataFrame, x: str | None = None, y: str | None = None, size: str | None = None,
                colour: str | None = None, nbins: int = 40) -> DataFrame:
    """xbin, ybin, colour, n, size (mean, as a share of the largest): the bubble chart for a large table."""
    numbers = numeric_columns(df)
    x, y, size = x or numbers[0], y or numbers[1], size or numbers[2]
    points = with_values(df, [x, y, size])
    (x0, x1), (y0, y1), (_, largest) = _range(points, x, y, size)
    if x0 is None:
        x0 = x1 = y0 = y1 = 0.0
    group = column(colour).cast("string") if colour else F.lit(None).cast("string")
    return points.groupBy(
        _bin(column(x).cast("double"), x0, x1, nbins).alias("xbin"),
        _bin(column(y).cast("double"), y0, y1, nbins).alias("ybin"), group.alias("colour"),
    ).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg(column(size).cast("double")), F.lit(largest)).alias("size"))


# --- distributions by category ------------------------------------------------------------------


def _grouped_values(df: DataFrame, y: str, x: str | None) -> DataFrame:
    """group_value, y without missing values."""
    group = column(x).cast("string") if x else F.lit(ALL)
    return df.select(group.alias("group_value"), column(y).cast("double").alias("y")).dropna()


def box_stats(df: DataFrame, y: str, x: str | None = None, **limits) -> DataFrame:
    """group_value, n, q1, median, q3, whisker_lo, whisker_hi, n_outliers, notch_lo, notch_hi.

    Whiskers reach to the last value inside 1.5 IQR, the notch is median +/- 1.57 IQR / sqrt(n).
    """
    values = _grouped_values(df, y, x)
    most = CATEGORY_MAX_DISTINCT
    counts = {
        r["group_value"]: r["n"]
        for r in values.groupBy("group_value").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    }
    if len(counts) > most:
        raise TooManyCategories(f"{x} has more than {most} values")
    # One conditional column per group: all groups share the passes of the quantile search.
    parts = {g: F.when(F.col("group_value") == F.lit(g), F.col("y")) for g in counts}
    quartiles = column_quantiles(values, parts, QUARTILES, counts=counts, **limits)
    if not counts:
        return df.sparkSession.createDataFrame([], BOX_SCHEMA)
    # At most ten groups: their quartiles enter the next pass as literals.
    names = ("n", "q1", "median", "q3")
    fitted = F.coalesce(*[
        F.when(F.col("group_value") == g, F.struct(*[
            F.lit(v).cast("long" if name == "n" else "double").alias(name)
            for name, v in zip(names, (n, *map(float, quartiles[g])))
        ])) for g, n in counts.items()
    ])
    values = values.withColumn("fit", fitted).select("group_value", "y", "fit.*")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("y") >= low) & (F.col("y") <= high)
    whiskers = values.groupBy("group_value", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("y"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("y"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )
    notch = 1.57 * iqr / F.sqrt("n")
    return whiskers.select(
        "*", (F.col("median") - notch).alias("notch_lo"), (F.col("median") + notch).alias("notch_hi")
    )


def violin_density(df: DataFrame, y: str, x: str | None = None, nbins: int = 100, points: int = 50) -> DataFrame:
    """group_value, grid, density: a Gaussian density per group on a fixed grid.

    The kernel is summed over bin counts, not rows: after the range is known, one pass turns the rows into at
    most groups x bins, and the spread of each group comes from the same bins.
    The bandwidth is 1.06 sigma n^-1/5. A group without spread has no density.
    """
    values = _grouped_values(df, y, x)
    if x:
        category_values(df, x, CATEGORY_MAX_DISTINCT)
    [(low, high)] = _range(values, "y")
    if low is None or low == high:
        return df.sparkSession.createDataFrame([], "group_value string, grid double, density double")
    width, step = (high - low) / nbins, (high - low) / (points - 1)
    bins = values.groupBy("group_value", _bin(F.col("y"), low, high, nbins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")
    )
    # The spread of a group from its bins: inside them and between their means. At most nbins rows per group.
    of_group = W.partitionBy("group_value")
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    bins = bins.withColumn("total", F.sum(n).over(of_group)).withColumn(
        "mean", F.sum(n * m).over(of_group) / F.col("total")
    ).withColumn("square", F.sum(n * (v + (m - F.col("mean")) * (m - F.col("mean")))).over(of_group))
    sigma = F.sqrt(F.try_divide(F.col("square"), F.col("total") - 1))
    bins = bins.withColumn("h", 1.06 * sigma * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    kernels = bins.where("h > 0").select(
        "group_value", "n", "total", "h",
        (low + (F.col("bin") - 0.5) * F.lit(width)).alias("middle"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"),
    )
    grid = low + F.col("k") * F.lit(step)
    z = (grid - F.col("middle")) / F.col("h")
    weight = F.col("n") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    return kernels.groupBy("group_value", "k").agg(F.sum(weight).alias("density")).select(
        "group_value", grid.alias("grid"), "density"
    )


# --- lines and areas ----------------------------------------------------------------------------


def _series(df: DataFrame, x: Column, y: str, group: str | None) -> DataFrame:
    group_value = column(group).cast("string") if group else F.lit(ALL)
    return df.select(x.alias("x"), group_value.alias("group_value"), column(y).cast("double").alias("y")).dropna(
        subset=["x"]
    )


def _bucket(at: Column, unit: str) -> Column:
    """Start of the bucket. A day is cut by date, which no session time zone can shift."""
    if unit == "day":
        return at.cast("date").cast("timestamp_ntz")
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def line_series(df: DataFrame, x: str | Column | None, y: str, group: str | None = None,
                key: list[str] | None = None) -> DataFrame:
    """x, group_value, y: every row that has an x, in the order of x. Without an x, the row position by
    ``key`` takes its place."""
    if x is None:
        df, x = row_index(df, key, "_position"), "_position"
    at = column(x) if isinstance(x, str) else x
    return _series(df, at, y, group).orderBy("x", "group_value", "y")


def line_bucketed(df: DataFrame, x: str | Column, y: str, group: str | None = None,
                  unit: str = "day") -> DataFrame:
    """bucket, group_value, n, avg_y, min_y, max_y: the line for a large table."""
    at = column(x) if isinstance(x, str) else x
    series = _series(df, _bucket(at, unit), y, group)
    return series.groupBy(F.col("x").alias("bucket"), "group_value").agg(
        F.count("y").alias("n"), F.avg("y").alias("avg_y"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def line_m4(df: DataFrame, x: str | Column | None, y: str, group: str | None = None, width: int = 400,
            key: list[str] | None = None) -> DataFrame:
    """group_value, pixel, n, first_x, first_y, last_x, last_y, low_x, low_y, high_x, high_y: the points from which a chart of
    ``width`` pixel columns draws the same line as from all rows.

    Of the points of a group in one pixel column, the first, the last, the least and the largest are kept, at most
    ``width`` rows per group: between two columns a line runs from last to first, inside one it covers low to high. x is a
    number, a date or a timestamp, or without one the row position by ``key``; ties in x go by y as in ``line_series``, ties
    in y by x. Rows without x or y are left out; one x only is pixel 0. Two scans: the range of x, and the points.
    """
    if x is None:
        df, x = row_index(df, key, "_position"), "_position"
    points = _series(df, column(x) if isinstance(x, str) else x, y, group).where(F.col("y").isNotNull())
    kind = points.schema["x"].dataType
    if isinstance(kind, T.DateType):
        at = F.unix_date("x").cast("double")
    elif isinstance(kind, T.TimestampNTZType):      # by its fields: no zone of the session shifts it
        at = F.expr("double(unix_date(cast(x as date)) * 86400000000 + hour(x) * 3600000000 + minute(x) * 60000000L"
                    " + bigint(extract(second from x) * 1000000))")
    elif isinstance(kind, T.TimestampType):
        at = F.unix_micros("x").cast("double")
    else:
        at = F.col("x").cast("double")
    low, high = points.agg(F.min(at), F.max(at)).first()
    place = F.lit(0) if low is None or low == high else F.least(
        F.floor((at - low) / (high - low) * width), F.lit(width - 1))
    row, up = F.struct("x", "y"), F.struct("y", "x")
    top = F.min(F.struct((-F.col("y")).alias("neg_y"), "x"))     # the largest y, and of its places the first
    return points.groupBy("group_value", place.cast("int").alias("pixel")).agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last"), F.min(up).alias("low"),
        top.alias("high")
    ).select("group_value", "pixel", "n", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("first", "last", "low") for c in ("x", "y")],
             F.col("high.x").alias("high_x"), (-F.col("high.neg_y")).alias("high_y"))


def _area(df: DataFrame, x: str | Column, y: str, group: str | None, unit: str | None) -> DataFrame:
    at = column(x) if isinstance(x, str) else x
    if unit:
        at = _bucket(at, unit)
    return _series(df, at, y, group).groupBy("x", "group_value").agg(F.sum("y").alias("y"))


def area(df: DataFrame, x: str | Column | None, y: str, unit: str | None = "day", key: list[str] | None = None
         ) -> DataFrame:
    """x, group_value ('all'), y: the sum per bucket. Without an x, the row position by ``key`` takes its place."""
    if x is None:
        df, x, unit = row_index(df, key, "_position"), "_position", None
    return _area(df, x, y, None, unit)


def area_stacked(df: DataFrame, x: str | Column | None, y: str, group: str, unit: str | None = "day",
                 key: list[str] | None = None) -> DataFrame:
    """x, group_value, y, y_top: each group on top of those before it. Missing groups are left out. Without an x,
    the row position by ``key`` takes its place, as in ``area``."""
    if x is None:
        df, x, unit = row_index(df, key, "_position"), "_position", None
    below = W.partitionBy("x").orderBy("group_value").rowsBetween(W.unboundedPreceding, 0)
    sums = _area(with_values(df, [group]), x, y, group, unit)
    return sums.withColumn("y_top", F.sum("y").over(below))


def area_share(df: DataFrame, x: str | Column | None, y: str, group: str, unit: str | None = "day",
               key: list[str] | None = None) -> DataFrame:
    """x, group_value, y, share: the part of each group in the total at x. Without an x, the row position by
    ``key`` takes its place, as in ``area``."""
    if x is None:
        df, x, unit = row_index(df, key, "_position"), "_position", None
    sums = _area(with_values(df, [group]), x, y, group, unit)
    return sums.withColumn("share", F.try_divide(F.col("y"), F.sum("y").over(W.partitionBy("x"))))


# --- several columns ----------------------------------------------------------------------------


def radar(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """group_value, feature, mean, scaled: group means on the 0-1 scale of the rows kept.

    With more than six groups the six most frequent are kept, by a literal filter. Means and ranges come
    from one grouped pass; the range over all kept rows is the range of the group ranges.
    """
    top = top_categories(df, group, RADAR_TOP_CATEGORIES + 1)
    kept = df.where(column(group).isin(top[:RADAR_TOP_CATEGORIES])) if len(top) > RADAR_TOP_CATEGORIES else df
    values = kept.select(column(group).cast("string").alias("group_value"),
                         *[column(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    aggregates = [a for i in range(len(features)) for a in (
        F.avg(f"f{i}").alias(f"m{i}"), F.min(f"f{i}").alias(f"lo{i}"), F.max(f"f{i}").alias(f"hi{i}"))]
    groups = values.groupBy("group_value").agg(*aggregates)
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"lo{i}").alias("lo"),
                 F.col(f"hi{i}").alias("hi")) for i, f in enumerate(features)
    ])).alias("r")
    # A few groups by at most five features.
    over = W.partitionBy("feature")
    long = groups.select("group_value", rows).select("group_value", "r.*").select(
        "group_value", "feature", "mean", F.min("lo").over(over).alias("lo"), F.max("hi").over(over).alias("hi")
    )
    spread = F.col("hi") - F.col("lo")
    return long.where("group_value is not null").select(
        "group_value", "feature", "mean",
        F.when(spread > 0, (F.col("mean") - F.col("lo")) / spread).otherwise(F.lit(0.0)).alias("scaled"),
    )


def treemap(df: DataFrame, levels: list[str], value: str | None = None) -> DataFrame:
    """level, h1.., total, n, colour, pct_parent, pct_root: every node of the hierarchy.

    One scan: rows are aggregated to the leaves, the leaves rolled up to all nodes; the total of a parent is that of the only row without the
    next level in the window of its path. The colour is the mean of the value weighted by itself. Rows without a key are
    left out, so NULL in a level means "all of it". Without a value the size is the row count.
    """
    names = [f"h{i + 1}" for i in range(len(levels))]
    v = column(value).cast("double") if value else F.lit(1.0)
    keyed = with_values(df, levels).select(
        *[column(c).cast("string").alias(h) for c, h in zip(levels, names)], v.alias("v")
    )
    level = sum((1 - F.grouping(h).cast("int") for h in names), F.lit(0))
    leaves = keyed.groupBy(*names).agg(
        F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    nodes = leaves.rollup(*names).agg(
        level.alias("level"), F.sum("s").alias("total"), F.sum("c").alias("n"),
        F.try_divide(F.sum("s2"), F.sum("s")).alias("colour"),
    )
    # Nodes are few (at most 20 values a level): one window per level and one over all of them.
    parent = F.lit(None).cast("double")
    for i in range(len(names)):
        path = W.partitionBy(*names[:i]) if i else W.partitionBy()
        above = F.max(F.when(F.col("level") == i, F.col("total"))).over(path)
        parent = F.when(F.col("level") == i + 1, above).otherwise(parent)
    root = F.max(F.when(F.col("level") == 0, F.col("total"))).over(W.partitionBy())
    return nodes.select(
        "level", *names, "total", "n", "colour",
        F.when(F.col("level") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("total"), parent)).alias("pct_parent"),
        F.try_divide(F.col("total"), root).alias("pct_root"),
    )
