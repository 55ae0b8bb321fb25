"""Chart tables on small frames and their invariants."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise import analyze, chart_tables, manifest, standard_charts
from tablewise.operators import charts
from tablewise.operators.charts import TooManyCategories


@pytest.fixture(scope="module")
def frame(spark):
    i = F.col("id")
    return spark.range(3000).select(
        "id", (F.randn(1) * 10 + 50).alias("x"), F.when(i % 10 != 0, F.rand(2) * 5).alias("y"),
        F.when(i % 3 == 0, "a").when(i % 7 == 0, "b").when(i % 11 != 0, "c").alias("g"),
        F.concat(F.lit("v"), (i % 9).cast("string")).alias("nine"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 20))").alias("t"),
    ).cache()


def test_histogram_counts_every_value(frame):
    table = charts.histogram(frame, "y", 12)
    assert table.agg(F.sum("n")).first()[0] == frame.where("y is not null").count()
    rows = table.orderBy("bin").collect()
    expected, edges = np.histogram([r.y for r in frame.select("y").dropna().collect()], bins=12)
    assert [r.n for r in rows] == expected.tolist()
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_constant_and_of_nothing(spark):
    assert [(r.bin, r.n) for r in charts.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x").collect()] == [(1, 3)]
    assert charts.histogram(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_composition_folds_the_rest(frame):
    folded = charts.composition(frame, "nine").collect()
    assert len(folded) == 8 and sum(r.n for r in folded) == 3000
    assert math.isclose(sum(r.pct for r in folded), 1)
    assert "Other" in {r.value for r in folded}
    assert charts.composition(frame, "nine", fold=False).count() == 9


def test_too_many_categories_are_refused(frame):
    many = frame.withColumn("many", F.col("id").cast("string"))
    for build in (lambda: charts.composition(many, "many"), lambda: charts.box_stats(many, "x", "many"),
                  lambda: charts.crosstab(many, "g", "many"), lambda: charts.violin_density(many, "x", "many")):
        with pytest.raises(TooManyCategories):
            build()


def test_crosstab_fills_absent_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x"), ("a", None)], "v string, g string")
    assert sorted(charts.crosstab(df, "v", "g").collect()) == [("a", 2, 0), ("b", 0, 1)]


def test_box_stats_agree_with_numpy(frame):
    for r in charts.box_stats(frame, "y", "g").collect():
        y = np.array([v.y for v in frame.where(F.col("g") == r.group_value).select("y").dropna().collect()])
        q1, median, q3 = np.quantile(y, [0.25, 0.5, 0.75])
        inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3))
        assert (r.whisker_lo, r.whisker_hi, r.n_outliers) == (inside.min(), inside.max(), len(y) - len(inside))


def test_box_stats_by_search(frame, monkeypatch):
    direct = {r.group_value: tuple(r) for r in charts.box_stats(frame, "y", "g").collect()}
    monkeypatch.setattr(charts, "column_quantiles", lambda df, cols, probs, counts: original(
        df, cols, probs, counts=counts, direct_rows=0, budget=20))
    from tablewise.operators.quantiles import column_quantiles as original
    searched = {r.group_value: tuple(r) for r in charts.box_stats(frame, "y", "g").collect()}
    assert searched.keys() == direct.keys()
    for g in direct:
        assert searched[g][1:] == pytest.approx(direct[g][1:])


def test_density_integrates_to_about_one(frame):
    rows = charts.violin_density(frame, "x").orderBy("grid").collect()
    step = rows[1].grid - rows[0].grid
    assert sum(r.density for r in rows) * step == pytest.approx(1, abs=0.02)


def test_areas(frame):
    whole = {r.x: r.y for r in charts.area(frame.dropna(subset=["g"]), "t", "x").collect()}
    stacked = charts.area_stacked(frame, "t", "x", "g").collect()
    top = {}
    for r in stacked:
        top[r.x] = max(top.get(r.x, 0), r.y_top)
    assert top == pytest.approx(whole)
    shares = {}
    for r in charts.area_share(frame, "t", "x", "g").collect():
        shares[r.x] = shares.get(r.x, 0) + r.share
    assert list(shares.values()) == pytest.approx([1] * 20)


def test_line_series_is_sorted_and_drops_missing_x(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (None, 3.0)], "x int, y double")
    assert [r.x for r in charts.line_series(df, "x", "y").collect()] == [1, 3]


def test_scatter_and_bubble(frame):
    complete = frame.where("y is not null").count()
    assert charts.scatter_points(frame, "x", "y", "g").count() == complete
    assert charts.scatter_density(frame, "x", "y").agg(F.sum("n")).first()[0] == complete
    bubbles = charts.bubble_points(frame, colour="g")
    assert bubbles.count() == complete and bubbles.agg(F.max("size")).first()[0] == 1.0


def test_radar_scales_by_the_rows_kept(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 1.0), ("b", 5.0, 1.0)], "g string, p double, q double")
    table = {(r.group_value, r.feature): (r["mean"], r.scaled) for r in charts.radar(df, "g", ["p", "q"]).collect()}
    assert table == {("a", "p"): (5.0, 0.5), ("a", "q"): (1.0, 0.0), ("b", "p"): (5.0, 0.5), ("b", "q"): (1.0, 0.0)}
    wide = spark.range(100).select((F.col("id") % 8).cast("string").alias("g"), F.col("id").alias("p"))
    assert {r.group_value for r in charts.radar(wide, "g", ["p"]).collect()} == set("012345")


def test_treemap_shares(frame):
    nodes = charts.treemap(frame, ["g", "nine"], "x").collect()
    root = [n for n in nodes if n.level == 0]
    assert len(root) == 1 and root[0].pct_parent == root[0].pct_root == 1.0
    for level in (1, 2):
        assert sum(n.total for n in nodes if n.level == level) == pytest.approx(root[0].total)
    for g in ("a", "b", "c"):
        assert sum(n.pct_parent for n in nodes if n.level == 2 and n.h1 == g) == pytest.approx(1)
    assert charts.treemap(frame, ["g"]).where("level = 0").first().total == frame.where("g is not null").count()


def test_standard_set(frame):
    plan = standard_charts(frame)
    assert [c.plot_type for c in plan] == ["histogram", "bar", "pie", "scatter", "box", "line", "heatmap"]
    assert plan[3].group == "g" and plan[4].title == "Box Plot of id by g" and plan[5].title == "Trend of id over time by g"
    assert manifest(frame).count() == 7
    assert all(t.count() > 0 for t in chart_tables(frame).values())


def test_standard_set_of_a_poor_table(spark):
    assert standard_charts(spark.createDataFrame([(None,)], "s string")) == []
    assert [c.plot_type for c in standard_charts(spark.range(3))] == ["histogram"]


def test_whole_analysis(frame):
    result = analyze(frame.select("x", "y", "g", "t"), exact_distinct=False)
    assert result.original.shape.first().n_rows == 3000
    assert result.cleaned.missing.where("n_missing > 0").count() == 0
    comparison = {r.column_name: r for r in result.comparison.collect()}
    assert comparison["y"].n_missing_before == 300 and comparison["y"].n_missing_after == 0
    assert set(result.original_charts) == set(result.cleaned_charts)


def test_box_stats_of_nothing(spark):
    assert charts.box_stats(spark.createDataFrame([(None,)], "y double"), "y").count() == 0


def test_m4_keeps_what_a_line_shows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.randint(0, 90)]), rng.choice("ab"), rng.choice([None, 1.0, -3.5, rng.random()])) for _ in range(600)]
    df = spark.createDataFrame(rows, "x int, g string, y double")
    points = [(x, g, y) for x, g, y in rows if x is not None and y is not None]
    low, high = min(p[0] for p in points), max(p[0] for p in points)
    columns = defaultdict(list)
    for x, g, y in points:
        columns[g, min(int((x - low) / (high - low) * 20), 19)].append((x, y))
    found = {(r["group_value"], r["pixel"]): r for r in charts.line_m4(df, "x", "y", "g", width=20).collect()}
    assert found.keys() == columns.keys()
    for k, own in columns.items():
        r = found[k]
        assert (r["first_x"], r["first_y"]) == min(own) and (r["last_x"], r["last_y"]) == max(own)
        assert (r["low_y"], r["low_x"]) == min((y, x) for x, y in own)
        assert (-r["high_y"], r["high_x"]) == min((-y, x) for x, y in own) and r["n"] == len(own)
    assert charts.line_m4(df.where("false"), "x", "y").count() == 0
    assert [r["pixel"] for r in charts.line_m4(df.where("x = 7"), "x", "y").collect()] == [0]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_m4_along_time(spark, kind):
    df = spark.sql(f"""select cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) as {kind}) as x, double(id) as y
                       from range(100)""")
    found = sorted(charts.line_m4(df, "x", "y", width=10).collect(), key=lambda r: r["pixel"])
    assert [r["pixel"] for r in found] == list(range(10)) and sum(r["n"] for r in found) == 100
    assert [r["last_y"] - r["first_y"] for r in found] == [r["n"] - 1 for r in found]


def test_every_level_of_the_quadtree_is_a_density(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), rng.choice([5.0, rng.random()]), rng.choice([None, 2, 7])) for _ in range(500)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, s int")
    tree = charts.density_quadtree(df, "x", "y", "s", levels=5).cache()
    for level in range(6):
        cells = {(r["xbin"], r["ybin"]): r["n"] for r in tree.where(f"level = {level}").collect()}
        plain = {(r["xbin"] - 1, r["ybin"] - 1): r["n"] for r in charts.scatter_density(df, "x", "y", 2 ** level).collect()}
        assert cells == plain
    sizes = [s for x, _, s in rows if x is not None and s is not None]
    assert tree.where("level = 0").first()["mean_size"] == pytest.approx(sum(sizes) / len(sizes))
    for r in tree.where("level = 5").collect():
        assert r["z"] == sum((r["xbin"] >> i & 1) << 2 * i | (r["ybin"] >> i & 1) << 2 * i + 1 for i in range(5))
    view = charts.quadtree_view(tree, 2, 1, 3, detail=2)
    assert sorted(view.collect()) == sorted(tree.where("level = 4 and shiftright(xbin, 2) = 1 and shiftright(ybin, 2) = 3").collect())
    assert charts.density_quadtree(df.where("false"), "x", "y").count() == 0
    assert {r["z"] for r in charts.density_quadtree(df.where("y = 5").withColumn("x", F.lit(1.0)), "x", "y").collect()} == {0}
