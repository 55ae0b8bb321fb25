"""Clustering against plain integer arithmetic; the tree against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewise.llm.clustering import cluster_vectors
from tablewise.llm.vantage_tree import TooLargeError, VantageTree, squared_distances

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, vector string, v string"


def brute(rows, k, rounds, dimensions, seed=1):
    """vec_id -> (cluster, distance), centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], centroids


@pytest.mark.parametrize(("k", "dimensions", "spread"), [(16, 64, 1.0), (40, 3, 0.1), (5, 2, 0.02), (3, 4, 1e5)])
def test_rounds(spark, k, dimensions, spread):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dimensions)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(100)]       # a group of equal vectors
    rows += [(600, None), (601, []), (602, [1.0] * (dimensions + 1)), (603, [math.nan] * dimensions),
             (604, [math.inf] + [0.0] * (dimensions - 1)), (605, [None] + [0.0] * (dimensions - 1)),
             (5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(5)
    result = cluster_vectors(df, k, 3, dimensions)
    expected, centroids = brute(rows, k, 3, dimensions)
    found = result.table().collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=str) == sorted(expected, key=str)
    assert result.centroids.tolist() == centroids
    assert {r["inertia"] for r in found} == {sum(d for *_, d in expected)}
    assert {(r["cluster"], r["cluster_inertia"]) for r in found} == {
        (n, sum(d for _, m, d in expected if m == n)) for n in {m for _, m, _ in expected}}
    assert {r["centroid_sha256"] for r in found if r["cluster"] == 0} <= {
        hashlib.sha256(",".join(map(str, centroids[0])).encode()).hexdigest()}


def test_few_vectors_none_and_no_ids(spark):
    def run(rows):
        return cluster_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 16, 3, 2).table().collect()

    assert run([]) == [] and run([(1, None), (2, [1.0])]) == []
    assert [(r["cluster"], r["distance"]) for r in run([(1, [1.0, -1.0])])] == [(0, 0)]
    assert {r["distance"] for r in run([(None, [1.0, 2.0]), (None, [3.0, 4.0])])} == {0}
    with pytest.raises(ValueError, match="centroids"):
        cluster_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 3), st.integers(0, 2**26), st.integers(0, 1000))
def test_the_tree_finds_the_nearest_point_and_the_smallest_on_ties(n, leaf, dimensions, size, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-size, size + 1, (n, dimensions)) if seed % 2 else rng.integers(-2, 3, (n, dimensions))
    vectors = np.concatenate([points, rng.integers(-size, size + 1, (20, dimensions)), rng.integers(-3, 4, (20, dimensions))])
    nearest, distance = VantageTree(points, leaf).nearest(vectors)
    every = ((vectors[:, None].astype(object) - points[None].astype(object)) ** 2).sum(2)
    assert nearest.tolist() == [min(range(n), key=lambda j: (row[j], j)) for row in every]
    assert distance.tolist() == [min(row) for row in every]


def test_a_search_leaves_branches_out(monkeypatch):
    import tablewise.llm.vantage_tree as module

    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 20, (2000, 2))
    tree, seen = VantageTree(points), []
    real = squared_distances
    monkeypatch.setattr(module, "squared_distances", lambda v, p: (seen.append(len(v) * len(p)), real(v, p))[1])
    tree.nearest(rng.integers(0, 1 << 20, (500, 2)))
    assert sum(seen) < 500 * 2000 / 10


def test_distances_beyond_64_bits_are_refused():
    with pytest.raises(TooLargeError):
        squared_distances(np.array([[1 << 31]]), np.array([[-(1 << 31)]]))
    assert squared_distances(np.array([[1 << 30]]), np.array([[-(1 << 30)]])).tolist() == [[1 << 62]]
