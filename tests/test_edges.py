"""Inputs that real tables have: odd names, missing roles, broken files, huge keys, maps, further rows."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise import analyze, chart_tables, clean_table, read_csv
from tablewise.operators import charts, clean, correlation, dates, ordering, profile, quantiles
from tablewise.plans.charts import Chart, chart_table
from tablewise.plans.cleaning import CleaningOptions
from tablewise.plans.compare import before_after
from tablewise.sources.staging import StagingFolderError, staging_folder
from tablewise.sources.tables import BrokenCsvError


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_staging_needs_a_shared_folder():
    with pytest.raises(StagingFolderError, match="spark.checkpoint.dir"):
        staging_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default)))


# --- files -----------------------------------------------------------------------------------------


def test_csv_surplus_field_is_refused(spark, tmp_path):
    with pytest.raises(BrokenCsvError, match="3,4,5"):
        read_csv(spark, written(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n"))


def test_csv_missing_fields_are_missing_values(spark, tmp_path):
    df = read_csv(spark, written(tmp_path, "a.csv", 'a,b\n1,2\n3\n"x ""y"" z",4\n'))
    assert [tuple(r) for r in df.collect()] == [("1", 2.0), ("3", None), ('x "y" z', 4.0)]


def test_csv_files_with_differing_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    written(folder, "1.csv", "a,b\n1,2\n")
    written(folder, "2.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(folder))


def test_csv_line_break_in_quotes(spark, tmp_path):
    path = written(tmp_path, "a.csv", 'a,b\n1,"x\ny"\n2,z\n')
    with pytest.raises(BrokenCsvError, match="multi_line"):
        read_csv(spark, path)
    assert [tuple(r) for r in read_csv(spark, path, multi_line=True).collect()] == [(1, "x\ny"), (2, "z")]


def test_csv_long_integers(spark, tmp_path):
    ids = [1790000000000000001, 1790000000000000002, -9223372036854775808]
    df = read_csv(spark, written(tmp_path, "a.csv", "id,big\n" + "".join(f"{i},{10**20}\n" for i in ids)))
    assert dict(df.dtypes) == {"id": "bigint", "big": "double"}
    assert [r["id"] for r in df.collect()] == ids


# --- quantiles -------------------------------------------------------------------------------------


def test_both_paths_give_the_same_bits(spark):
    df = spark.range(1000).select((F.randn(3) * 17.3 + 25).alias("x"), F.round(F.rand(5) * 9, 2).alias("y"))
    probs = [0.0, 0.1, 0.25, 0.37, 0.5, 0.75, 0.999, 1.0]
    direct = quantiles.exact_quantiles(df, ["x", "y"], probs)
    assert direct == quantiles.exact_quantiles(df, ["x", "y"], probs, direct_rows=0, budget=20)


def test_hot_key_beyond_doubles_ends(spark):
    hot = 2**60 + 701
    df = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, hot).otherwise(
        F.lit(2**60) + F.xxhash64("id") % 1000).alias("k"))
    found = quantiles.exact_quantiles(df, ["k"], [0.1, 0.5, 0.9], direct_rows=0, budget=10)["k"]
    ks = np.sort(np.array([r["k"] for r in df.collect()], dtype=object))
    for value, p in zip(found, (0.1, 0.5, 0.9)):
        low, high = ks[int(p * 29_999)], ks[int(np.ceil(p * 29_999))]
        assert float(low) <= value <= float(high)


@pytest.mark.parametrize("low,high", [(3, 4), (-7, 900), (-1.0, 1.0), (0.0, 1e308), (-1e-300, 5.0), (-9.0, -1.0)])
def test_midpoint_lies_between(low, high):
    middle = quantiles.midpoint(low, high)
    assert low <= middle < high


# --- tables without a role -------------------------------------------------------------------------


TABLES = {
    "texts": "values ('a', 'x'), ('b', null), ('a', 'x') as t(s, u)",
    "numbers": "values (1, 2.5D), (2, null), (3, 7.5D) as t(i, d)",
    "flags": "values (true), (false), (null) as t(f)",
}


@pytest.mark.parametrize("kind", list(TABLES))
def test_tables_of_one_kind(spark, kind):
    df = spark.sql(f"select * from {TABLES[kind]}")
    numbers = [c for c, t in df.dtypes if t in ("int", "double")]
    texts = [c for c, t in df.dtypes if t == "string"]
    assert profile.describe(df).count() == len(numbers)
    assert profile.short_stats(df).count() == len(numbers)
    assert {r["column_name"] for r in profile.value_counts(df).collect()} == set(texts)
    assert profile.top_values(df).count() == (0 if not texts else 3)
    assert dates.detect_by_sample(df, df.columns[:1]).count() == len(texts)
    assert before_after(df, df).count() == len(df.columns)
    result = analyze(df)
    for table in (result.comparison, result.cleaned.numbers, result.cleaned.missing, result.cleaning.action_log()):
        table.collect()


# --- names -----------------------------------------------------------------------------------------


def test_any_column_name(spark):
    odd = spark.sql("select id as `a key`, cast(id % 3 as string) as `l.flag`, cast(id % 2 as string) as `it``s`, "
                    "id * 1.5D as `sepal.length`, id * id * 1.0D as `b c`, id % 7 * 1.0D as `d``e` from range(40)")
    x, y, z, g, h = "sepal.length", "b c", "d`e", "l.flag", "it`s"
    tables = [
        charts.histogram(odd, x), charts.crosstab(odd, g, h), charts.composition(odd, g), charts.scatter_points(odd, x, y, g),
        charts.scatter_density(odd, x, y), charts.scatter_reference_line(odd, x, y), charts.bubble_points(odd, x, y, z, g),
        charts.bubble_bins(odd, x, y, z, g), charts.box_stats(odd, y, g), charts.violin_density(odd, y, g),
        charts.line_series(odd, x, y, g), charts.area(odd, x, y, None), charts.area_stacked(odd, x, y, g, None),
        charts.area_share(odd, x, y, g, None), charts.radar(odd, g, [x, y, z]), charts.treemap(odd, [g, h], y),
        profile.describe(odd), profile.column_info(odd), profile.column_info(odd, exact=False), profile.value_counts(odd),
        profile.modes(odd, [g]), profile.missing_counts(odd), profile.group_means(odd, g, [x]), correlation.correlation(odd),
        clean.cap_outliers(odd), clean.impute_median(odd), clean.title_text(odd), clean.drop_duplicate_wide_rows(odd),
        ordering.drop_missing_key(odd, [g, x]), ordering.keep_top_categories(odd, g, 2), ordering.row_index(odd, ["a key"]),
        dates.detect_by_sample(odd, ["a key"]), dates.detect_by_rate(odd), clean_table(odd).cleaned,
    ]
    for table in tables:
        table.collect()
    for table in chart_tables(odd).values():
        table.collect()


# --- further rows, maps, charts --------------------------------------------------------------------


def test_model_cleans_further_rows(spark):
    fitted = spark.range(300).select((F.col("id") % 10).alias("i"), (F.col("id") % 10 * 1.0).alias("x"), F.lit("a").alias("s"))
    further = spark.createDataFrame([(10**9, 1e9, None), (None, None, "b")], "i bigint, x double, s string")
    capped = clean_table(fitted).model.transform(further).collect()
    assert max(r["x"] or 0 for r in capped) < 100 and None in {r["x"] for r in capped}
    rows = clean_table(fitted, CleaningOptions(reusable=True)).model.transform(further).collect()
    assert all(r["i"] is not None and r["i"] < 100 for r in rows)
    assert all(r["x"] is not None and r["x"] < 100 for r in rows)
    assert all(r["s"] is not None for r in rows)


def test_maps_pass_through_cleaning(spark):
    df = spark.sql("select * from values (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), (2, null) as t(i, m)")
    cleaned = clean_table(df).cleaned
    assert sorted((r["i"], r["m"]) for r in cleaned.where("m is not null").collect()) == [(1, {"a": 1, "b": 2})]
    assert cleaned.count() == 2 and dict(cleaned.dtypes)["m"] == "map<string,int>"


@pytest.mark.parametrize("variant", ["simple", "stacked", "share"])
def test_area_over_row_positions(spark, variant):
    df = spark.sql("select id, cast(id % 2 as string) as g, id * 1.0D as y from range(10)")
    table = chart_table(df, Chart("area", "", "index", "y", "g", variant), key=["id"])
    assert [r["x"] for r in table.orderBy("x").collect()] == list(range(10))


def test_binned_forms_are_asked_for(spark):
    df = spark.sql("select id * 1.0D as a, id * 2.0D as b, id * 3.0D as c, "
                   "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as t from range(2000)")
    few = [chart_table(df, c, binned=True).count() for c in (
        Chart("scatter", "", "a", "b"), Chart("bubble", "", "a", "b"), Chart("line", "", "t", "a"))]
    assert max(few) <= 90
    assert chart_table(df, Chart("scatter", "", "a", "b")).count() == 2000


def test_correlation_of_many_incomplete_columns_needs_two_scans(spark, monkeypatch):
    k = 40
    df = spark.range(400).select(*[
        F.when(F.col("id") % (i + 3) != 0, F.randn(i) + F.col("id") * (i % 3) / 100).alias(f"c{i}") for i in range(k)]).cache()
    passes = []
    counted = correlation.aggregate_row
    monkeypatch.setattr(correlation, "aggregate_row", lambda d, a: passes.append(-(-len(a) // 96)) or counted(d, a))
    found = {(r["col_x"], r["col_y"]): r["r"] for r in correlation.correlation(df).collect()}
    assert sum(passes) == 2      # 161 counts, ranges and means in two passes; one more scan for all 780 pairs
    expected = df.toPandas().corr()
    for (x, y), r in found.items():
        assert r == pytest.approx(expected.loc[x, y], abs=1e-9)
