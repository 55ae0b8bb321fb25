"""Cleaning rules on small frames of our own, one per rule or peculiarity."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise import CleaningOptions, clean_table
from tablewise.functions.text import strip, title_case
from tablewise.operators import clean


def values(df, name):
    return [r[0] for r in df.select(name).collect()]


def actions(result):
    return [(r.column_name, r.action_type, r.n_affected, r.description) for r in
            result.action_log().orderBy("seq").collect()]


def numbers(spark, items, ddl="x double"):
    return spark.createDataFrame([(i,) for i in items], ddl)


@pytest.mark.parametrize("text", [
    "1-URGENT", "o'neil 3rd a-b", "they're", "  two  words ", "ÉCOLE élan", "中a ǆ", "", "a1b2", "ß x", "x_y.z",
    "ªb", "ΑΒΓ δεζ",
])
def test_title_case_is_that_of_python(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(title_case(F.col("s"))).first()
    assert row[0] == text.title()


@pytest.mark.parametrize("text", [
    " a ", "\ta\n", "\u00a0a\u2003", "\u2028a", "\x1ca\x1f", "a b", "", "   ", "\u3000x ", "\u200bx",
])
def test_strip_is_that_of_python(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(strip(F.col("s"))).first()
    assert row[0] == text.strip()


def test_median_is_exact_and_widens(spark):
    df = numbers(spark, [1, 2, 3, 10, None], "x int")
    filled = clean.impute_median(df)
    assert sorted(values(filled, "x")) == [1.0, 2.0, 2.5, 3.0, 10.0]
    assert filled.schema["x"].dataType == T.DoubleType()


def test_column_without_missing_keeps_its_type(spark):
    assert clean.impute_median(numbers(spark, [1, 2], "x int")).schema["x"].dataType == T.IntegerType()


def test_mode_takes_the_smallest_of_ties(spark):
    df = numbers(spark, ["b", "a", "b", "a", "c", None], "s string")
    assert sorted(values(clean.impute_mode(df), "s")) == ["a", "a", "a", "b", "b", "c"]


def test_text_without_values_becomes_unknown(spark):
    assert values(clean.impute_mode(numbers(spark, [None, None], "s string")), "s") == ["Unknown"] * 2


def test_number_without_values_stays_missing_and_is_logged(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    result = clean_table(df)
    assert values(result.cleaned, "x") == [None, None]
    assert [a[:3] for a in actions(result)] == [("x", "fill_missing", 0)]


def test_boolean_with_missing_is_filled_and_stays_boolean(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "k int, b boolean")
    result = clean_table(df)
    assert sorted(result.cleaned.collect()) == [(1, True), (2, True), (3, False), (4, True)]
    assert result.cleaned.schema["b"].dataType == T.BooleanType()


def test_boolean_without_missing_is_left_alone(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "k int, b boolean")
    assert actions(clean_table(df)) == []


def test_duplicates_are_removed_after_imputing(spark):
    # The missing value becomes 2, which makes the rows equal.
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("b", 2.0)], "s string, x double")
    result = clean_table(df)
    assert sorted(result.cleaned.collect()) == [("a", 2.0), ("b", 2.0)]
    assert ("all", "remove_duplicates", 1, "Removed 1 duplicate rows") in actions(result)


def test_duplicates_treat_null_and_signed_zero_as_equal(spark):
    df = spark.createDataFrame([(None, 0.0), (None, -0.0)], "s string, x double")
    assert clean.drop_duplicate_rows(df).count() == 1


def test_wide_duplicates_agree_with_plain(spark):
    rows = spark.range(300).select((F.col("id") % 100).cast("string").alias("s"),
                                   F.when(F.col("id") % 3 == 0, F.lit("x" * 50)).alias("t"))
    hot = rows.unionByName(spark.range(200).select(F.lit("hot").alias("s"), F.lit(None).cast("string").alias("t")))
    plain = sorted(map(str, clean.drop_duplicate_rows(hot).collect()))
    assert sorted(map(str, clean.drop_duplicate_wide_rows(hot).collect())) == plain
    assert sorted(map(str, clean.drop_duplicate_wide_rows(hot, broadcast_rows=5).collect())) == plain


def test_wide_duplicates_without_any_keep_all_rows(spark):
    assert clean.drop_duplicate_wide_rows(spark.range(50)).count() == 50


def test_capping_uses_three_iqr_and_keeps_missing(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 1000.0, None])
    capped = values(clean.cap_outliers(df), "x")
    assert capped[:4] == [1.0, 2.0, 3.0, 4.0] and capped[4] == 4.0 + 3 * 2.0 and capped[5] is None


def test_value_on_the_bound_is_no_outlier(spark):
    df = numbers(spark, [0.0, 0.0, 1.0, 1.0, 4.0])   # q1 0, q3 1, upper bound 4
    assert clean.outlier_counts(df).collect() == [("x", 0)]


def test_zero_iqr_caps_to_the_constant_unless_told_not_to(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 9 else 7.0) for i in range(10)], "k int, x double")
    result = clean_table(df)
    assert set(values(result.cleaned, "x")) == {5.0}
    assert any("quartiles are equal" in a[3] for a in actions(result))
    assert set(values(clean_table(df, CleaningOptions(skip_zero_iqr=True)).cleaned, "x")) == {5.0, 7.0}


def test_excluded_column_is_not_capped(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 1000.0])
    assert max(values(clean_table(df, CleaningOptions(exclude=("x",))).cleaned, "x")) == 1000.0


def test_uncapped_integer_keeps_its_type(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(5, 1e6)], "k int, x double")
    schema = clean_table(df).cleaned.schema
    assert schema["k"].dataType == T.IntegerType() and schema["x"].dataType == T.DoubleType()


def text_frame(spark, words, rows):
    return spark.range(rows).select(
        "id", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") % len(words) + 1).cast("int")).alias("s")
    )


def test_text_rules_on_few_values(spark):
    result = clean_table(text_frame(spark, ["Red", " red", "BLUE"], 300))
    assert sorted(set(values(result.cleaned, "s"))) == ["Blue", "Red"]
    logged = [a for a in actions(result) if a[1] == "standardize_text"]
    assert logged == [
        ("s", "standardize_text", 100, "Stripped whitespace from 100 values"),
        ("s", "standardize_text", 1, "Standardized text case, reducing unique values from 3 to 2"),
    ]


def test_title_case_is_applied_even_when_not_logged(spark):
    result = clean_table(text_frame(spark, ["red", "blue"], 300))
    assert sorted(set(values(result.cleaned, "s"))) == ["Blue", "Red"]
    assert not [a for a in actions(result) if a[1] == "standardize_text"]


def test_too_few_rows_for_text_rules(spark):
    # 20 rows: at most 2 distinct values to be stripped, never title case.
    result = clean_table(text_frame(spark, [" a", "b"], 20))
    assert sorted(set(values(result.cleaned, "s"))) == ["a", "b"]
    assert sorted(set(values(clean_table(text_frame(spark, [" a", "b", "c"], 20)).cleaned, "s"))) == [" a", "b", "c"]


def test_column_between_the_limits_is_stripped_only(spark):
    words = [f" w{i}" for i in range(60)]
    result = clean_table(text_frame(spark, words, 1200))
    assert sorted(set(values(result.cleaned, "s"))) == sorted(w.strip() for w in words)


def test_eligibility_table_on_many_values(spark):
    df = spark.range(5000).select(F.concat(F.lit(" v"), "id").alias("many"), F.lit("x").alias("one"))
    table = {r.column_name: tuple(r)[1:] for r in clean.text_eligibility(df).collect()}
    assert table == {"many": (5000, False, False), "one": (1, True, True)}


def test_booleans_as_text_print_like_python(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert values(df.select(clean.as_text(df, "b").alias("b")), "b") == ["True", "False", None]


def test_date_texts_are_filled_with_the_most_common_unless_told_not_to(spark):
    df = spark.createDataFrame([(1, "1/2/2024"), (2, "1/2/2024"), (3, "5/6/2024"), (4, None)], "k int, d string")
    assert values(clean_table(df).cleaned.orderBy("k"), "d")[3] == "1/2/2024"
    kept = CleaningOptions(impute_dates=False, date_columns=("d",))
    assert values(clean_table(df, kept).cleaned.orderBy("k"), "d")[3] is None


def test_true_dates_are_in_no_cleaning_role(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, d string").select("k", F.col("d").cast("date"))
    assert actions(clean_table(df)) == []


def test_model_applies_to_further_rows(spark):
    df = text_frame(spark, [" red", "Blue"], 300).withColumn("x", F.when(F.col("id") > 0, F.col("id") % 10))
    model = clean_table(df).model
    more = spark.createDataFrame([(1, "  GREEN ", None), (1, "  GREEN ", None)], "id long, s string, x long")
    assert model.transform(more).collect() == [(1, "Green", 5.0)]


def test_cleaning_leaves_no_missing_and_stays_inside_bounds(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 7 != 0, F.randn(1) * F.when(F.col("id") % 50 == 0, 100).otherwise(1)).alias("x"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("string")).alias("s"),
    )
    result = clean_table(df)
    row = result.cleaned.agg(F.count_if(F.col("x").isNull() | F.col("s").isNull()), F.min("x"), F.max("x")).first()
    bounds = result.model.bounds["x"]
    assert row[0] == 0 and bounds.lower <= row[1] and row[2] <= bounds.upper
    assert clean.drop_duplicate_rows(result.cleaned).count() == result.cleaned.count()


def test_report_and_issues(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "s string, x double")
    result = clean_table(df)
    assert tuple(result.report().first())[:4] == (3, 2, 2, 2)
    assert sorted(result.issue_table().collect()) == [("all", "duplicate", 1), ("x", "missing", 1)]
    assert result.top_actions(1).count() == 1


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (2.0, "a")], ["a.b", "c d`e"])
    result = clean_table(df)
    assert result.cleaned.columns == ["a.b", "c d`e"]
    assert sorted(result.cleaned.collect()) == [(1.0, "a"), (1.5, "a"), (2.0, "a")]
