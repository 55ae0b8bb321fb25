"""Centroid clustering of integer vectors: Lloyd's rounds with exact arithmetic, over a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import claim_worker
from tablewise.llm.vantage_tree import VantageTree
from tablewise.sources.staging import stage

SCALE = 64
#: Components of all centroids: what is broadcast and collected in a round is 8 bytes for each.
MOST_COMPONENTS = 1 << 21


def integer_vectors(df: DataFrame, dimensions: int, id_col: str = "vec_id", vector_col: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the vectors of exactly ``dimensions`` components, none missing or not finite, as integers
    floor(scale * x) with x as a double. Other rows, a missing vector among them, are left out."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = (F.size("v") == dimensions) & F.forall(
        "v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))      # NaN is above infinity
    return df.select(F.col(id_col).alias("vec_id"), values.alias("v")).where(F.coalesce(whole, F.lit(False))).select(
        "vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")).alias("vector"))


def _matrix(rows: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _sums(shared, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count and sums of the vectors of each cluster, one row for each cluster that the task meets. Components that have
    64-bit distances are below 2^28, so that the sums of one task fit 64 bits."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("clustering")
        tree: VantageTree = shared.value
        counts = np.zeros(len(tree.points), np.int64)
        sums = np.zeros((len(tree.points), dimensions), np.int64)
        for rows in batches:
            vectors = _matrix(rows, dimensions)
            cluster, _ = tree.nearest(vectors)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            if len(met):
                counts[met] += np.diff(np.append(first, len(order)))
                sums[met] += np.add.reduceat(vectors[order], first, axis=0)
        met = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(counts[met]),
                               pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return add


def _assigned(shared, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("clustering")
        for rows in batches:
            cluster, distance = shared.value.nearest(_matrix(rows, dimensions))
            yield pa.record_batch([rows.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                  names=["vec_id", "cluster", "distance"])

    return assign


@dataclass
class Clustering:
    """``assigned`` has vec_id, cluster and distance (squared) of every vector; ``centroids`` one row for each cluster."""

    assigned: DataFrame
    centroids: np.ndarray

    def centroid_digests(self) -> list[str]:
        """SHA-256 of the components as decimal integers with commas between."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]

    def table(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. One row per cluster joins."""
        found = self.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
        spark = self.assigned.sparkSession
        inertia = {r["cluster"]: r["cluster_inertia"] for r in found.collect()}     # one row per centroid
        total = sum(inertia.values())
        rows = [(k, inertia.get(k, 0), total, digest) for k, digest in enumerate(self.centroid_digests())]
        facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return self.assigned.join(F.broadcast(facts), "cluster").select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids by their components."""
    keyed = vectors.where("vec_id is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    return np.array([r["vector"] for r in keyed.orderBy("h", "vector").limit(k).collect()], np.int64)


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, seed: int = 1,
                    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> Clustering:
    """``rounds`` rounds of assigning every vector to its nearest centroid and moving the centroids to the floor of the
    mean of their vectors; then the vectors are assigned once more.

    All arithmetic is exact: components are integers, distances squared, ties go to the smaller centroid, sums and
    quotients are integers of any size. Each round builds a vantage-point tree over the centroids and broadcasts it (k *
    ``dimensions`` numbers, at most ``MOST_COMPONENTS``); a task returns one row for each cluster, so that a cluster which
    holds most vectors is no hot key. A centroid without vectors stays. With fewer than ``k`` vectors each is a centroid.

    Defined results: vectors of another length, with a missing or non-finite component, or missing, are left out; a row
    without an id is assigned but is no first centroid, unless no row has an id; repeated rows are vectors of their own; an
    empty table gives no rows. Components whose squared distances exceed 64 bits raise ``TooLargeError``, sums of
    distances beyond 64 bits Spark's overflow error.
    """
    if not 0 < k * dimensions <= MOST_COMPONENTS:
        raise ValueError(f"between 1 and {MOST_COMPONENTS // dimensions} centroids of {dimensions} components")
    spark: SparkSession = df.sparkSession
    vectors = stage(integer_vectors(df, dimensions, id_col, vector_col, scale), "integer-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        centroids = first_centroids(vectors.withColumn("vec_id", F.lit("")), k, seed)
    if not len(centroids):
        return Clustering(vectors.selectExpr("vec_id", "cast(null as int) as cluster", "cast(null as bigint) as distance"),
                          centroids.reshape(0, dimensions))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = vectors.mapInArrow(_sums(shared, dimensions), "cluster bigint, n bigint, sums array<bigint>")
        parts = sums.select("cluster", "n", F.posexplode("sums").alias("i", "x"))
        totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        moved = centroids.copy()
        for r in totals.toArrow().to_pylist():      # as many rows as centroids have components
            moved[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
        centroids = moved
        shared.unpersist()
    shared = spark.sparkContext.broadcast(VantageTree(centroids))
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    assigned = vectors.mapInArrow(_assigned(shared, dimensions), f"vec_id {id_type}, cluster int, distance bigint")
    return Clustering(stage(assigned, "assigned-vectors"), centroids)
