"""Operators that need an order or a membership: row positions, top-k filters, rows without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tablewise.operators.roles import column, free_names, with_values
from tablewise.sources.staging import stage

_PARTITION_BITS = 33   # monotonically_increasing_id keeps the position in the partition in the low bits


def row_index(df: DataFrame, key: list[str], name: str = "row_index") -> DataFrame:
    """Add the position of each row, from 0, in the order of ``key``.

    A window over the whole table would sort it in one task. Here the rows are range-partitioned by the
    key, sorted and numbered inside their partition, and written once; the partition sizes, a table with
    one row per partition, then give each partition its offset. The ranges are cut by all key columns and
    then by a hash of the row, so a hot key is split by the next column or by the rest of its rows.
    """
    order = [column(k).asc_nulls_last() for k in key]
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order.append(F.xxhash64(*[column(c) for c in hashable]))
    id_, part, pos, n, offset = free_names(df, "_id", "_part", "_pos", "_n", "_offset")
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(id_, F.monotonically_increasing_id())
    numbered = stage(ids.withColumn(part, F.shiftright(id_, _PARTITION_BITS)).withColumn(
        pos, F.col(id_) - F.shiftleft(part, _PARTITION_BITS)).drop(id_), "row-index")
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = numbered.groupBy(part).agg(F.count(F.lit(1)).alias(n)).select(
        part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    # One row per partition: small enough to send to every task.
    indexed = numbered.join(F.broadcast(offsets), part)
    return indexed.withColumn(name, F.col(offset) + F.col(pos)).drop(part, pos, offset)


def top_categories(df: DataFrame, name: str, k: int) -> list[str]:
    """The k most frequent values, ties by value: at most k values reach the driver."""
    counts = df.where(column(name).isNotNull()).groupBy(column(name).alias("value")).count()
    return [r["value"] for r in counts.orderBy(F.desc("count"), "value").limit(k).collect()]


def keep_top_categories(df: DataFrame, name: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent. The filter is a literal list, so a scan can prune by it."""
    return df.where(column(name).isin(top_categories(df, name, k)))


def drop_missing_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows in which every key column is present."""
    return with_values(df, key)
