"""The quantile search against numpy, on shapes that hurt: hot values, constants, gaps, tiny budgets."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewise.operators.quantiles import approximate_quantiles, exact_quantiles, quantile_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(df, columns, **limits):
    frame = df.select(*columns).toPandas()
    found = exact_quantiles(df, columns, PROBS, **limits)
    for c in columns:
        present = frame[c].dropna().astype(float).to_numpy()
        if len(present) == 0:
            assert found[c] == [None] * len(PROBS)
        else:
            np.testing.assert_allclose(np.array(found[c], float), np.quantile(present, PROBS), rtol=1e-12, atol=1e-12)


@pytest.fixture(scope="module")
def shapes(spark):
    i = F.col("id")
    return spark.range(40_000).select(
        F.when(i % 3 == 0, 7).otherwise(F.xxhash64("id") % 100003).alias("hot"),
        F.when(i % 3 == 0, -1.5).when(i % 3 == 1, 2.5).otherwise(F.randn(3)).alias("two_hot"),
        F.lit(5.5).alias("constant"), (i % 5).cast("int").alias("few"),
        F.when(i % 2 == 0, F.exp(F.randn(5) * 4)).alias("tail"),
        F.when(i < 3, i.cast("double")).alias("sparse"),
        F.lit(None).cast("double").alias("empty"),
        (i.cast("decimal(12,2)") / 4).cast("decimal(12,2)").alias("money"),
        F.randn(9).cast("float").alias("single"),
        (i + 9_000_000_000_000_000_000).alias("huge"),
    ).repartition(5).cache()


ALL = ["hot", "two_hot", "constant", "few", "tail", "sparse", "empty", "money", "single"]


@pytest.mark.parametrize("budget", [5, 500, 10**6])
def test_search(shapes, budget):
    check(shapes, ALL, direct_rows=0, budget=budget)


def test_direct(shapes):
    check(shapes, ALL)


def test_huge_integers_are_searched_exactly(shapes):
    assert exact_quantiles(shapes, ["huge"], [0.0], direct_rows=0, budget=10)["huge"] == [9e18]


def test_search_with_a_poor_sketch(shapes, monkeypatch):
    # Ends that miss the wanted ranks must only cost rounds.
    monkeypatch.setattr("tablewise.operators.quantiles.SKETCH_ROWS", 15)
    check(shapes, ["hot", "two_hot", "tail"], direct_rows=0, budget=50)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.floats(-1e6, 1e6, allow_subnormal=False)), min_size=1,
                max_size=60))
def test_search_on_any_list(spark, items):
    df = spark.createDataFrame(pd.DataFrame({"x": pd.Series(items, dtype=float)})).select(
        F.when(~F.isnan("x"), F.col("x")).alias("x"))
    check(df, ["x"], direct_rows=0, budget=2)


def test_approximate_returns_values_of_the_column(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert approximate_quantiles(df, ["x"], [0.5])["x"][0] in (2, 3)
    assert quantile_table(df, ["x"], [0.25]).collect() == [("x", 0.25, 1.75)]
