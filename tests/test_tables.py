"""Reading, typing, profiling, dates and order."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise import convert_types, normalize_missing, read_csv, require_rows, write_csv, write_table
from tablewise.constants import MISSING_TOKENS
from tablewise.functions.dates import DATE_FORMATS, format_named, parse_any_date, parse_date
from tablewise.operators import dates, ordering, profile, roles
from tablewise.operators.correlation import correlation
from tablewise.sources.staging import new_path, stage
from tablewise.sources.tables import EmptyTableError

CSV = '''amount,age,name,joined,active,maybe,empty,code,ratio
10.5,30,"Smith, ""J""",1/2/2024,True,True,,0012,1e3
NaN,,n/a,NA,False,NaN,nan,7,-inf
3,41, padded ,12/31/2023,true,False,null,15,.5
'''


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_follow_the_whole_column(spark, csv_file):
    df = read_csv(spark, csv_file)
    assert dict(df.dtypes) == {
        "amount": "double", "age": "double", "name": "string", "joined": "string", "active": "boolean",
        "maybe": "string", "empty": "double", "code": "bigint", "ratio": "double",
    }
    rows = df.collect()
    assert tuple(rows[0]) == (10.5, 30.0, 'Smith, "J"', "1/2/2024", True, "True", None, 12, 1000.0)
    assert tuple(rows[1]) == (None, None, None, None, False, None, None, 7, float("-inf"))
    assert rows[2].name == " padded "


def test_csv_agrees_with_pandas(spark, csv_file):
    ours, theirs = read_csv(spark, csv_file).toPandas(), pd.read_csv(csv_file)
    for c in theirs.columns:
        assert ours[c].isna().tolist() == theirs[c].isna().tolist(), c
    for c in ("amount", "age", "code", "ratio"):
        assert ours[c].dropna().tolist() == theirs[c].dropna().tolist()


def test_csv_with_schema_and_staging(spark, csv_file):
    df = read_csv(spark, csv_file, schema="age int, name string", staged=True)
    assert df.schema == T.StructType.fromDDL("age int, name string")
    assert sorted(r.age or 0 for r in df.collect()) == [0, 30, 41]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', 0.1), (2, "  spaces  ", 1e-7)], "k long, s string, x double")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(read_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_write_table(spark, tmp_path):
    write_table(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_missing_tokens_and_nan(spark):
    df = spark.createDataFrame([(t, float("nan")) for t in MISSING_TOKENS] + [("ok", 1.0)], "s string, x double")
    assert normalize_missing(df).dropna().collect() == [("ok", 1.0)]
    assert normalize_missing(df).where("s is null and x is null").count() == len(MISSING_TOKENS)


def test_empty_tables_are_refused(spark):
    with pytest.raises(EmptyTableError):
        require_rows(spark.createDataFrame([], "x int"))
    with pytest.raises(EmptyTableError):
        require_rows(spark.range(1).select())
    assert require_rows(spark.range(1)).count() == 1


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).withColumn("s", F.lit(None).cast("string"))
    assert stage(df, "test").schema.simpleString() == df.schema.simpleString()
    assert sorted(stage(df, "test").collect()) == sorted(df.collect())
    assert new_path(spark, "a") != new_path(spark, "a")


def test_roles(spark):
    df = spark.sql("""select 1 a, 1.5 b, double(1) c, 's' d, date'2024-01-01' e, timestamp'2024-01-01' f,
                      timestamp_ntz'2024-01-01' g, true h, array(1) i""")
    assert [c.role for c in roles.column_roles(df)] == [
        "numeric", "numeric", "numeric", "categorical", "datetime", "datetime", "datetime", "other", "other"]
    assert roles.project_role(df, roles.NUMERIC).columns == ["a", "b", "c"]


def test_boolean_with_missing_values_is_a_category(spark):
    df = spark.createDataFrame([(True, True), (None, False)], "a boolean, b boolean")
    assert [r.role for r in roles.role_table(df).orderBy("position").collect()] == ["categorical", "other"]


def test_describe_agrees_with_pandas(spark):
    frame = pd.DataFrame({"a": [1, 2, 3, 10], "b": [0.5, None, 2.5, None], "c": [None] * 4}).astype(float)
    df = normalize_missing(spark.createDataFrame(frame))
    expected = frame.describe().T
    for r in profile.describe(df).collect():
        e = expected.loc[r.column_name]
        ours = [r.cnt, r.mean, r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]]
        for x, y in zip(ours, e):
            assert (x is None and pd.isna(y)) or x == pytest.approx(y)


def test_column_info_counts_every_type(spark):
    df = spark.sql("""select * from values
        (1, 0.0D, 'a', timestamp_ntz'2024-01-01', true, array(1)),
        (1, -0.0D, 'b', null, true, array(1)),
        (null, null, null, null, null, null) as t(i, d, s, t, b, a)""")
    info = {r.column_name: (r.non_null, r.n_null, r.n_unique) for r in profile.column_info(df).collect()}
    assert info == {"i": (2, 1, 1), "d": (2, 1, 1), "s": (2, 1, 2), "t": (1, 2, 1), "b": (2, 1, 1), "a": (2, 1, 1)}
    sketched = {r.column_name: r.n_unique for r in profile.column_info(df.drop("a"), exact=False).collect()}
    assert sketched == {"i": 1, "d": 1, "s": 2, "t": 1, "b": 1}
    assert {r.column_name: r.n_unique for r in profile.approximate_distinct_counts(df.select("i", "s")).collect()} \
        == {"i": 1, "s": 2}


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"] + [(None,)], "s string")
    assert [(r.value, r.n, r.rnk) for r in profile.top_values(df, k=3).orderBy("rnk").collect()] == [
        ("a", 2, 1), ("b", 2, 2), ("c", 2, 3)]


def test_correlation_agrees_with_pandas(spark):
    frame = pd.DataFrame({
        "a": [1e9 + v for v in (1.0, 2.0, 3.0, 4.5, 7.0)], "b": [5.0, 3.0, 4.0, 1.0, 0.0], "same": [0.1] * 5,
        "gaps": [1.0, None, 2.0, None, 9.0], "none": [None] * 5, "gaps_same": [2.0, 2.0, None, 2.0, 2.0],
    }).astype(float)
    expected = frame.corr()
    for r in correlation(normalize_missing(spark.createDataFrame(frame))).collect():
        e = expected.loc[r.col_x, r.col_y]
        assert (r.r is None and pd.isna(e)) or r.r == pytest.approx(e, abs=1e-7), r


def test_group_means_leave_out_missing_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0), ("b", None)], "g string, x double")
    assert sorted(profile.group_means(df, "g", ["x"]).collect()) == [("a", 2.0), ("b", None)]


def parsed(spark, text, fmt=None):
    c = F.col("s")
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(parse_date(c, format_named(fmt)) if fmt else parse_any_date(c)).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("2024-02-29", (2024, 2, 29)), ("2/29/2024", (2024, 2, 29)), ("31/12/2023", (2023, 12, 31)),
    ("2023/1/5", (2023, 1, 5)), ("5.1.2023", (2023, 1, 5)), ("Jan 5, 2023", (2023, 1, 5)),
    ("5 January 2023", (2023, 1, 5)), ("05-MAR-2023", (2023, 3, 5)), ("2024-01-02 03:04:05", (2024, 1, 2, 3, 4, 5)),
    ("1/2/2024 3:04", (2024, 1, 2, 3, 4)), ("2024-01-05T10:00:00Z", (2024, 1, 5, 10)),
    ("2024-01-05T10:00:00+02:00", (2024, 1, 5, 10)), ("1/5/2024 3:04 PM", (2024, 1, 5, 15, 4)),
    ("1/5/2024 12:04:05 am", (2024, 1, 5, 0, 4, 5)), ("20240105", (2024, 1, 5)), ("1/5/24", (2024, 1, 5)),
    ("1/5/71", (1971, 1, 5)), ("31/5/24", (2024, 5, 31)), ("JANUARY 5, 2024", (2024, 1, 5)), ("5 sept 2024", (2024, 9, 5)),
])
def test_dates_parse(spark, text, expected):
    assert parsed(spark, text) == datetime.datetime(*expected)


@pytest.mark.parametrize("text", [
    "2023-02-29", "13/32/2023", "T1018", "2023", "12:30", "junk", "", None, "Foo 5, 2023", "Mayor 5, 2020", "Marble 3, 2021", "13/45/24", "20241340", "12345678",
    "1/5/2024 13:04 PM", "1/5/2024 0:04 AM", "x" * 5000,
])
def test_no_dates(spark, text):
    assert parsed(spark, text) is None


def test_one_format_per_column_wins(spark):
    df = spark.createDataFrame([(f"{d}/1/2024",) for d in range(1, 13)] + [("25/1/2024",)], "d string")
    assert dates.category_facts(df).formats["d"][0].name == "d/M/yyyy"
    same = spark.createDataFrame([("1/2/2024",)], "d string")
    assert dates.category_facts(same).formats["d"][0].name == "M/d/yyyy"
    assert len({f.name for f in DATE_FORMATS}) == len(DATE_FORMATS)


@pytest.mark.parametrize("good,rate", [(8, True), (7, False)])
def test_missing_counts_against_the_rate(spark, good, rate):
    rows = [(f"2024-01-{i + 1}",) for i in range(good)] + [(None,)] * (10 - good)
    df = spark.createDataFrame(rows, "d string")
    assert dates.detect_by_rate(df).collect() == [("d", good / 10, rate)]
    assert ("d_date" in dates.materialize_dates(df).columns) == rate


def test_rate_of_a_column_with_many_values(spark):
    df = spark.range(1000).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")),
                                                "M/d/yyyy").alias("d"))
    assert dates.date_columns(df)["d"].name == "M/d/yyyy"


def test_sample_takes_the_first_by_key(spark):
    rows = [(i, "2024-01-01" if i < 3 else "no") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, d string").repartition(4)
    assert dates.detect_by_sample(df, ["k"]).collect() == [("d", 5, 3, True)]
    assert dates.detect_by_sample(df.where("k > 0"), ["k"]).collect() == [("d", 5, 2, False)]


def test_convert_types(spark):
    df = spark.createDataFrame(
        [(str(i) if i else "x", f"2024-01-{i + 1}" if i else "x", "t") for i in range(10)], "n string, d string, t string")
    converted = convert_types(df)
    assert [t for _, t in converted.dtypes] == ["double", "timestamp_ntz", "string"]
    assert converted.where("n is null and d is null").count() == 1


def test_row_index_over_several_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("hot")).repartition(7)
    indexed = ordering.row_index(df, ["k"])
    assert indexed.where("row_index != k").count() == 0
    by_hot = ordering.row_index(df, ["hot", "k"]).orderBy("row_index").collect()
    assert [(r.hot, r.k) for r in by_hot] == sorted((r.hot, r.k) for r in by_hot)
    assert [r.row_index for r in by_hot] == list(range(5000))


def test_top_categories_and_missing_keys(spark):
    df = spark.createDataFrame([(v,) for v in "aabbc"] + [(None,)], "s string")
    assert ordering.top_categories(df, "s", 2) == ["a", "b"]
    assert ordering.keep_top_categories(df, "s", 2).count() == 4
    assert ordering.drop_missing_key(df, ["s"]).count() == 5


def test_preview(spark):
    assert [r.id for r in profile.preview(spark.range(100).repartition(5), ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_wide_tables_are_profiled_in_parts(spark):
    df = spark.range(50).select("id", *[(F.col("id") * i).alias(f"n{i}") for i in range(1, 130)],
                                F.when(F.col("id") > 9, "x").alias("s"))
    missing = {r.column_name: r.n_missing for r in profile.missing_counts(df).collect()}
    assert len(missing) == 131 and missing["s"] == 10 and missing["n7"] == 0
    stats = {r.column_name: r for r in profile.describe(df).collect()}
    assert len(stats) == 130 and stats["n100"].q50 == 2450.0 and stats["n100"]["max"] == 4900.0
    assert profile.column_info(df, exact=False).count() == 131
