"""Quality rules: repetition inside a document, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm.common import SMALL_ROWS, claim_worker, free_names, rows_of, small, text_digest
from tablewise.llm.grams import mix, shingles, word_hashes
from tablewise.llm.ngram_join import ngram_join
from tablewise.sources.staging import stage

#: Fixed values
SYMBOLS = "[#*$%&|<>]"[1:-1]
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST_WORDS, MOST_REPEATED = 10, 20     # base rules: words, per cent of words in repeated windows
WINDOW = 5

#: A line is boilerplate of a host if at least so many unrelated documents have it, whatever the size of the host.
LINE_DOCS = 10
#: A document is depleted if less than this share of its words is left without boilerplate.
LEFT_SHARE = 0.3

RULES = ("row bigint, doc_id bigint, digest bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, "
         "n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h:bigint,words:int>>")


def repeated_words(grams: np.ndarray, gram_first: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each text inside a window of ``size`` words that the text has twice or more."""
    n, texts = np.diff(first), len(first) - 1
    text = np.repeat(np.arange(texts), np.diff(gram_first))
    key = grams ^ mix(text.astype(np.uint64) + np.uint64(1))     # equal only within a text
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.arange(len(key)) - gram_first[text] + first[text]     # the window's first word
    at = at[twice & (n[text] >= size)]
    edge = np.zeros(first[-1] + size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:first[-1]] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def line_hashes(text: str, digest) -> tuple[int, dict[int, int]]:
    """(lines equal to an earlier line, hash of each distinct normalised line -> its words, all occurrences)."""
    seen: set[str] = set()
    duplicates, words_of = 0, {}
    for line in text.split("\n"):
        if words := line.lower().split():
            if line in seen:
                duplicates += 1
            seen.add(line)
            h = digest(" ".join(words))
            words_of[h] = words_of.get(h, 0) + len(words)
        elif line.strip(SPACES):      # words of white space beyond ASCII: a line with a word by the base rules
            duplicates += line in seen
            seen.add(line)
    return duplicates, words_of


def _line_digest() -> Callable[[str], int]:
    from xxhash import xxh3_64_intdigest

    return lambda line: xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim_worker("quality")
    digest = _line_digest()
    line_type = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int32())]))
    for rows in rows_of(batches):
        words, first = word_hashes(rows.column("text"))
        grams, gram_first = shingles(words, first, WINDOW)
        repeated = repeated_words(grams, gram_first, first)
        out = []
        for text in rows.column("text").to_pylist():
            duplicates, lines = line_hashes(text, digest)
            out.append((len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates,
                        [{"h": h, "words": n} for h, n in lines.items()]))
        chars, symbols, duplicates, lines = zip(*out)
        yield pa.record_batch(
            [rows.column("row"), rows.column("doc_id"), rows.column("digest"), rows.column("host"), pa.array(np.diff(first)),
             pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(duplicates, pa.int64()),
             pa.array(repeated), pa.array(lines, line_type)],
            names=["row", "doc_id", "digest", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "lines"])


def boilerplate_lines(lines: DataFrame, texts: DataFrame, line_docs: int) -> DataFrame:
    """(host, h): the lines that ``line_docs`` or more unrelated documents of a host have."""
    carriers = lines.groupBy("host", "h", "digest").agg(F.count(F.lit(1)).alias("copies"))
    shared = stage(carriers.groupBy("host", "h").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= line_docs)
                   .select("host", "h"), "quality-shared-lines")
    # only lines that are left go through a second shuffle
    carriers = stage(lines.join(small(shared), ["host", "h"]).select("host", "h", "digest").distinct(), "quality-carriers")
    if carriers.isEmpty():
        return shared
    digests = stage(carriers.select("digest").distinct(), "quality-carrying-texts")
    joined = ngram_join(texts.join(small(digests), "digest", "left_semi"), "digest", "text")
    kinds = stage(joined.groupBy(F.col("doc_id").alias("digest")).agg(F.min("component_id").alias("kind")), "quality-kinds")
    unrelated = carriers.join(small(kinds), "digest").groupBy("host", "h", "kind").agg(F.count(F.lit(1)).alias("texts"))
    return unrelated.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= line_docs).select("host", "h")


def _host(host_col: str) -> Column:
    """A missing host is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  line_docs: int = LINE_DOCS, lines_too: bool = False) -> DataFrame:
    """One row per document: row, doc_id, digest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_boilerplate_words, depleted, kept; with ``lines_too`` also host and the hashes of its boilerplate lines.

    Lines are normalised (lower case, single spaces) and hashed. What counts for a line is the number of unrelated
    documents of the host that have it: the distinct components of ``ngram_join`` (Jaccard similarity 3/4) among them, or
    a group of copies or near copies would lose all its members. Equal texts are counted once first; only texts with a
    line that enough different ones share go to the join, so that components are those among these texts. A document is
    depleted if its boilerplate leaves less than ``LEFT_SHARE`` of its words.

    Defined results: a missing or empty text has no words and fails the base rules; a missing host is a host of
    its own; repeated rows are documents of their own (``row`` tells them apart); an empty table gives no rows.
    Texts are read twice. They do not move while those to join are few enough to broadcast their digests; beyond that
    the semi join shuffles.
    """
    texts = df.select(F.col(id_col).alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      _host(host_col).alias("host"),
                      F.monotonically_increasing_id().alias("row"), text_digest(text_col).alias("digest"))
    rules = stage(texts.mapInArrow(_rules, RULES), "quality-rules")
    lines = rules.select("row", "digest", "host", F.explode("lines").alias("line")).select(
        "row", "digest", "host", "line.h", "line.words")
    boilerplate = stage(boilerplate_lines(lines, texts, line_docs), "quality-boilerplate")
    # a list of lines, not of documents: while it is short, no line of the corpus moves for it
    removed = lines.join(small(boilerplate), ["host", "h"]).groupBy("row").agg(
        F.sum("words").alias("n_boilerplate_words"), F.collect_set("h").alias("boilerplate"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = left < F.lit(LEFT_SHARE) * F.col("n_words")
    return rules.drop("lines").join(removed, "row", "left").fillna(0, ["n_boilerplate_words"]).select(
        "row", "doc_id", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), "n_boilerplate_words", depleted.alias("depleted"),
        (~base_failed & ~depleted).alias("kept"), *(["host", "boilerplate"] if lines_too else []))


@F.arrow_udf(T.StringType())
def _without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these hashes; None where there is nothing to do."""
    claim_worker("quality")
    digest = _line_digest()
    out = []
    for text, hashes in zip(texts.to_pylist(), gone.to_pylist()):
        if text is not None and hashes is not None:
            unwanted = set(hashes)
            text = "\n".join(line for line in text.split("\n") if digest(" ".join(line.lower().split())) not in unwanted)
        else:
            text = None
        out.append(text)
    return pa.array(out, pa.string())


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              line_docs: int = LINE_DOCS) -> DataFrame:
    """The documents, with all their columns, that ``quality_rules`` keeps, and their texts without boilerplate lines.

    What is joined are the ids of rejected documents and the hashes of the lines that go, by id, text and host.
    """
    names = free_names(df, "judged_id", "judged_digest", "judged_host", "judged_lines")
    rules = quality_rules(df, id_col, text_col, host_col, line_docs, lines_too=True)
    judged = stage(rules.where("not kept or boilerplate is not null").select(
        "doc_id", "digest", "host", F.when(F.col("kept"), F.sort_array("boilerplate")).alias("lines")).distinct(), "quality-judged")

    def same(side: DataFrame) -> Column:
        return (F.col(id_col).eqNullSafe(side[names[0]]) & (text_digest(text_col) == side[names[1]])
                & (_host(host_col) == side[names[2]]))

    rejected = judged.where("lines is null").select("doc_id", "digest", "host").toDF(*names[:3])
    good = df.join(small(rejected), same(rejected), "left_anti")
    cut = judged.where("lines is not null").toDF(*names)
    # a list of hashes for each document: broadcast by the number of hashes
    size = cut.agg(F.sum(F.size(names[3]) + 4)).first()[0] or 0
    if not size:
        return good
    joined = good.join(F.broadcast(cut) if size <= SMALL_ROWS else cut, same(cut), "left")
    touched = F.when(F.col(names[3]).isNotNull(), F.col(text_col).cast("string"))
    return joined.withColumn(text_col, F.coalesce(_without_lines(touched, F.col(names[3])), F.col(text_col))).drop(*names)
