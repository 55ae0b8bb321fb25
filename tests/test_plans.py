"""The shape of the physical plans: narrow scans, no Python, no product joins, one scan where one is enough."""

import pytest

from tablewise.operators import charts, clean, profile, recommend
from tablewise.plans.compare import before_after
from workload.inputs import dirty_lineitem, recommendations, table
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_product_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def read_columns(text: str) -> set[str]:
    start = text.index("ReadSchema: struct<") + len("ReadSchema: struct<")
    return {c.split(":")[0] for c in text[start:text.index(">", start)].split(",")}


def test_scans_read_only_what_is_needed(spark):
    lineitem = table(spark, FOLDER, "lineitem")
    assert read_columns(plan(charts.area(lineitem, "l_shipdate", "l_tax"))) == {"l_shipdate", "l_tax"}
    assert read_columns(plan(profile.value_counts(lineitem, ["l_returnflag"]))) == {"l_returnflag"}
    assert read_columns(plan(profile.group_means(lineitem, "l_linestatus", ["l_tax"]))) == {"l_linestatus", "l_tax"}


def test_one_scan_for_all_columns(spark):
    dirty = dirty_lineitem(spark, FOLDER)
    for df in (profile.basic_stats(dirty), profile.missing_counts(dirty), profile.value_counts(dirty),
               profile.column_info(dirty), clean.drop_duplicate_rows(dirty)):
        assert plan(df).count("FileScan") == 1


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["q_topk_member_filter"](spark, FOLDER))
    assert "PushedFilters: [In(p_brand" in text


def test_counts_are_partial_before_the_shuffle(spark):
    text = plan(profile.value_counts(table(spark, FOLDER, "part")))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_rank_limit_is_applied_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(profile.top_values(table(spark, FOLDER, "part")))


def test_texts_are_planned_without_a_shuffle(spark):
    sections = recommend.chart_types(recommend.numbered_sections(recommendations(spark, FOLDER)))
    facts = recommend.TableFacts(["l_quantity", "l_tax"], ["l_returnflag"], [], {"l_returnflag": 3})
    assert "Exchange" not in plan(recommend.chart_plan(sections, facts))
    assert "Exchange" not in plan(recommend.column_mentions(sections, facts))


def test_charts_with_fitted_ranges_scan_once(spark):
    lineitem = table(spark, FOLDER, "lineitem")
    for df in (charts.histogram(lineitem, "l_tax"), charts.violin_density(lineitem, "l_tax", "l_returnflag"),
               charts.radar(lineitem, "l_returnflag", ["l_tax"]), charts.crosstab(lineitem, "l_linestatus", "l_returnflag")):
        assert plan(df).count("FileScan") == 1
    assert plan(charts.treemap(table(spark, FOLDER, "part"), ["p_type", "p_brand"], "p_size")).count("FileScan") == 1


def test_a_nearly_unique_text_shuffles_its_candidates_only(spark):
    df = spark.range(50_000).selectExpr("if(id % 4 = 0, concat('often ', id % 12), concat('once ', id)) as t", "cast(id % 9 as string) as few")
    found = profile.heavy_values(df, ["t", "few"], 3)
    assert found == {"t": [("often 0", 4167), ("often 4", 4167), ("often 8", 4166)]}      # few values are counted the plain way
    assert "Exchange" not in plan(profile.top_values(df.select("t"), k=3))       # what is left to run is a list
    assert profile.heavy_values(df, ["t"], 4) == {}       # the fourth is one of many: nothing is proven
    plain = profile.top_values(df, k=4).where("column_name = 't' and rnk = 4").first()
    assert (plain["value"], plain["n"]) == ("once 1", 1)


def test_wide_duplicates_by_bitmap_move_only_rows_that_may_have_copies(spark):
    df = spark.range(4_000).selectExpr("if(id < 500, id % 100, id) as id", "repeat('x', 200) as `_hash`", "1 as `_bits`")
    found = clean.drop_duplicate_wide_rows(df, broadcast_rows=5)
    assert found.columns == df.columns and found.count() == 3_600
    moved = [n for n in plan(found).splitlines() if "Exchange hashpartitioning" in n]
    assert len(moved) == 1 and "BroadcastExchange" in plan(found)


def test_a_sketched_comparison_scans_each_side_once(spark):
    lineitem = table(spark, FOLDER, "lineitem").drop("l_shipdate", "l_comment")
    assert plan(before_after(lineitem, lineitem.where("l_tax > 0"), exact=False)).count("FileScan") == 2
    found = {r["column_name"]: r for r in profile.column_profile(lineitem, exact=False).collect()}
    for r in profile.column_profile(lineitem).collect():
        near = found[r["column_name"]]
        assert (near["n_missing"], near["min"], near["max"]) == (r["n_missing"], r["min"], r["max"])
        assert near["n_unique"] == pytest.approx(r["n_unique"], rel=0.15)
        assert (near["mean"] is None) == (r["mean"] is None) and near["mean"] == pytest.approx(r["mean"])
        assert near["std"] == pytest.approx(r["std"])


def test_a_zoomed_chart_reads_a_range_of_the_stored_tree(spark, tmp_path):
    tree = charts.density_quadtree(table(spark, FOLDER, "lineitem"), "l_partkey", "l_extendedprice", levels=6)
    tree.write.parquet(str(tmp_path / "tree"))
    text = plan(charts.quadtree_view(spark.read.parquet(str(tmp_path / "tree")), 2, 1, 2, detail=3))
    assert "GreaterThanOrEqual(z," in text and "LessThan(z," in text
