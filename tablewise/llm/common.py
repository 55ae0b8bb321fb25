"""What the operators share: reading, shared folders, sizes."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch between the JVM and a Python worker. Documents are long; the default of 10,000 rows may be
#: gigabytes.
BATCH_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table of documents; batches to Python workers are kept small."""
    small_batches(spark)
    return table(spark, folder, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: fewer rows in a batch, unless fewer are set already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_owner = ""
_caches: list = []


def worker_cache(maxsize: int):
    """A cache in the Python worker, kept between the tasks of one operator."""
    def cached(function):
        _caches.append(found := functools.lru_cache(maxsize)(function))
        return found

    return cached


def claim_worker(operator: str) -> None:
    """Called by the first lines of a task: when the worker served another operator before, its caches are dropped and
    the memory goes back, so that the stages of a pipeline do not add up."""
    global _owner
    if _owner != operator:
        for cache in _caches:
            cache.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # where the C library has it
            trim(0)
    _owner = operator


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """(doc_id, text) with '' for a missing text, and other columns."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     *others)


def text_digest(text_col: str) -> Column:
    """Tells documents that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def rows_of(batches: Iterable[pa.RecordBatch], bytes_most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``bytes_most`` bytes of text (one row at least)."""
    for batch in batches:
        start = size = 0
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = pc.binary_length(column).to_pylist() if len(column) else []
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > bytes_most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if len(column) > start:
            yield batch.slice(start)


#: Rows of a few numbers that may be broadcast: some 50 MB.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The side of a join, marked for broadcast if it has few rows; beyond that Spark joins by shuffle. ``df`` is a
    written table, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


_CARRIED = "carried_"


def with_carried(df: DataFrame, carry: list[str], taken: list[str], *columns) -> DataFrame:
    """``columns`` and the columns to carry along, these under names that clash with nothing."""
    if clash := {c.lower() for c in carry} & set(taken):
        raise ValueError(f"columns called like a result cannot be carried: {sorted(clash)}")
    quoted = ["`" + c.replace("`", "``") + "`" for c in carry]
    return df.select(*columns, *[F.col(q).alias(f"{_CARRIED}{i}") for i, q in enumerate(quoted)])


def carried_names(rows: pa.RecordBatch) -> list[str]:
    return [n for n in rows.schema.names if n.startswith(_CARRIED)]


def carried(rows: pa.RecordBatch) -> list[pa.Array]:
    return [rows.column(n) for n in carried_names(rows)]


def carried_schema(results: str, df: DataFrame) -> T.StructType:
    return T.StructType(T.StructType.fromDDL(results).fields + [f for f in df.schema.fields if f.name.startswith(_CARRIED)])


def back_to_names(df: DataFrame, carry: list[str]) -> DataFrame:
    return df.withColumnsRenamed({f"{_CARRIED}{i}": c for i, c in enumerate(carry)})
