"""From documents to packed training sequences: five stages, each written and read again before the next.

Quality rules, one document of each group of near copies, repeated passages, personal data, packing. All stages but
the last return the columns of documents, with ``n_chars`` counted anew where they change a text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import documents, small_batches
from tablewise.llm.ngram_join import keep_one_of_each
from tablewise.llm.packing import pack
from tablewise.llm.pii import replace_pii
from tablewise.llm.quality import keep_good
from tablewise.llm.suffix_dedup import remove_repeats
from tablewise.sources.staging import stage

#: Surrogates of this run; a user sets a secret key
PII_KEY = b"key of the corpus pipeline"
#: A passage of some fifty words of prose
REPEAT_BYTES = 250
SEQUENCE_TOKENS = 1024


def _new_texts(docs: DataFrame, change: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``docs`` with the texts that ``change`` gives them, whatever their other columns are called."""
    names = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    plain = docs.select(*[F.col(q).alias(names.get(c, c)) for q, c in zip(quoted, docs.columns)])
    changed = change(plain, list(names.values()))
    return _counted(changed.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns]))


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and from the others the lines that many unrelated documents of a host share."""
    small_batches(spark)
    return _counted(keep_good(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one of least id stays."""
    small_batches(spark)
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES that start at two places go. A character of which only some bytes go, goes."""
    small_batches(spark)
    return _new_texts(docs, lambda plain, others: remove_repeats(
        plain, length=REPEAT_BYTES, carry=others, as_text=True).withColumnRenamed("kept", "text"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    small_batches(spark)
    return _new_texts(docs, lambda plain, others: replace_pii(plain, PII_KEY, carry=others))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of SEQUENCE_TOKENS."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=SEQUENCE_TOKENS, end_id=0,
                special=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pii", private_data),
    ("packing", packing),
]

#: SQL cannot say shingle joins, suffix sorting, surrogates and tokenizers; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
