"""From text to chart plans, against a plain reading of the rules in Python."""

import random

import pytest

from tablewise import chart_table, recommended_charts
from tablewise.constants import CHART_WORDS
from tablewise.operators import recommend


def sections(spark, text):
    df = recommend.numbered_sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    return [(r.section, r.description) for r in df.orderBy("section").collect()]


def test_sections(spark):
    text = "intro\n 1. one \n\n more\t\n10. not a section\n2.\n**3. neither**\n4. four\r\n9.abc"
    assert sections(spark, text) == [
        (1, "1. one more 10. not a section 2. **3. neither**"), (2, "4. four"), (3, "9.abc"),
    ]


@pytest.mark.parametrize("text", ["", "no sections here", "\n\n", "1.", "1. "])
def test_no_sections(spark, text):
    assert sections(spark, text) == []


def test_missing_text(spark):
    assert sections(spark, None) == []


def plain_type(text):
    text = text.lower()
    return next((t for t, words in CHART_WORDS if any(w in text for w in words)), None)


@pytest.mark.parametrize("text", [
    "1. a violin plot of the distribution", "1. discounts by store", "1. Correlation Matrix", "1. TREEMAP of x",
    "1. heat map here", "1. spider plot", "1. nothing at all", "1. boxplot frequency", "1. a stacked area",
])
def test_first_matching_word_wins(spark, text):
    df = recommend.chart_types(spark.createDataFrame([(1, 1, text)], "doc_id int, section int, description string"))
    assert df.first()["plot_type"] == plain_type(text)


def test_short_sections_are_ignored(spark):
    df = spark.createDataFrame([(1, 1, "1. boxplo"), (1, 2, "1. boxplot")], "doc_id int, section int, description string")
    assert [r.section for r in recommend.chart_types(df).collect()] == [2]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(
        [(i, float(i % 7), i * 0.5, "abc"[i % 3], f"s{i % 12}", f"{i % 12 + 1}/{i % 28 + 1}/2024", f"n{i}")
         for i in range(400)],
        "id int, price double, weight double, kind string, shop string, day string, note string",
    )


def plan(store, text):
    return [(c.plot_type, c.x, c.y, c.group, c.variant) for c in recommended_charts(store, text)]


@pytest.mark.parametrize("text,expected", [
    ("1. Histogram of weight and price", ("histogram", "price", None, None, None)),
    ("1. Bar chart of shop by kind", ("bar", "kind", None, None, None)),
    ("1. Pie chart of shop and kind", ("pie", "kind", None, None, None)),
    ("1. Scatter of weight against price, by kind", ("scatter", "price", "weight", "kind", None)),
    ("1. Boxplot of weight by shop", ("box", None, "weight", None, None)),
    ("1. Line chart of price over day by kind", ("line", "day", "price", "kind", None)),
    ("1. Line chart of price", ("line", "day", "price", None, None)),
    ("1. Line chart of price per note", ("line", "note", "price", None, None)),
    ("1. Stacked area chart of price, kind, day", ("area", "day", "price", "kind", "stacked")),
    ("1. Area chart of price, kind, day", ("area", "day", "price", "kind", "share")),
    ("1. Heatmap of everything", ("heatmap", None, None, None, None)),
    ("1. Bubble chart by kind", ("bubble", "id", "price", "kind", "size=weight")),
    ("1. Violin plot of price by kind", ("violin", "kind", "price", None, None)),
    ("1. Radar chart by shop", ("radar", "id, price, weight", None, "kind", None)),
    ("1. Treemap of shop in kind by weight", ("treemap", "kind > shop", "weight", None, None)),
    ("1. Treemap, please", ("treemap", "kind > shop", "id", None, None)),
])
def test_plan(store, text, expected):
    assert plan(store, text) == [expected]


def test_every_planned_chart_has_a_table(store):
    text = "\n".join([
        "1. Histogram of price", "2. Bar chart of kind", "3. Pie chart of kind", "4. Scatter of price, weight",
        "5. Boxplot of price by kind", "6. Line chart of price over day", "7. Area chart of price, kind, day",
        "8. Heatmap of all", "9. Bubble chart by kind",
    ])
    charts = recommended_charts(store, text)
    assert len(charts) == 9
    more = "1. Violin of price by kind\n2. Radar chart by kind\n3. Treemap of kind by price\n4. stacked area of price, kind"
    for chart in charts + recommended_charts(store, more):
        assert chart_table(store, chart).count() > 0, chart


def test_text_without_charts_falls_back_to_the_standard_set(store):
    assert plan(store, "nothing to see")[0][0] == "histogram"
    assert [c.plot_type for c in recommended_charts(store, "1. no such chart")] == [
        "histogram", "bar", "pie", "scatter", "box", "line", "heatmap"]


def test_line_over_row_positions(spark):
    df = spark.createDataFrame([(i, float(-i)) for i in range(20)], "id int, price double")
    [chart] = recommended_charts(df, "1. Line chart of price")
    assert chart.x == "index"
    rows = chart_table(df, chart, key=["id"]).orderBy("x").collect()
    assert [(r.x, r.y) for r in rows] == [(i, float(-i)) for i in range(20)]


def test_many_names_are_found_by_their_fragments(spark):
    rng = random.Random(5)
    names = [f"col_{i:04d}" for i in range(300)] + [f"{a}{b}" for a in "xyz" for b in "qw"] + [
        "Net Sales", "net", "Größe", "ÉTAT", "a;b,c", "it's", "back\\slash", "two\nlines", "$1", "sales"]
    rng.shuffle(names)
    texts = [" ".join(rng.choice(names + ["plain", "words", "COL_"]).upper() if rng.random() < 0.5 else rng.choice(names)
                      for _ in range(rng.randint(0, 8))) for _ in range(150)] + ["", "xq", "col_", "TWO\nLINES it's", None]
    sections = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, section int, description string")
    facts = recommend.TableFacts(names, [], [], {})
    found = {(r["doc_id"], r["column_name"]): r["rnk"] for r in recommend.column_mentions(sections, facts).collect()}
    expected = {}
    for i, t in enumerate(texts):
        for rank, n in enumerate([n for n in names if n.lower() in (t or "").lower()], 1):
            expected[i, n] = rank
    assert found == expected and len(found) > 300
    plain = recommend.FEW_NAMES
    try:
        recommend.FEW_NAMES = len(names)
        again = {(r["doc_id"], r["column_name"]): r["rnk"] for r in recommend.column_mentions(sections, facts).collect()}
    finally:
        recommend.FEW_NAMES = plain
    assert again == found
