"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.sources.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the least of the node and its neighbours."""
    both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, goes to the least neighbour."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.withColumnRenamed("least", "b"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node of the component.

    Alternating large and small stars, each written to the shared folder, until a round changes nothing: a number of
    rounds that grows with the logarithm of the longest chain. (In one plan a round would hold its links eight times,
    and the driver keeps the plan of every query.) A node of very many links is summed
    up before the shuffle, and its links are a skewed join that Spark splits. Links of a node to itself are allowed;
    a table without links gives no rows.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "links")
    before, after = None, mark(now)
    while before != after and after[0]:
        now = stage(_small_star(stage(_large_star(now), "large-star")).distinct(), "links")
        before, after = after, mark(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
