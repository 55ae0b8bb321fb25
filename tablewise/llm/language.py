"""Language identification by compression: the language whose dictionary gives the smallest encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm.common import claim_worker, rows_of, with_text

#: Bounds of what is learned: documents and characters of each for one language, bytes of a dictionary, languages
LEARN_DOCS, LEARN_CHARS, DICTIONARY_BYTES, MOST_LANGUAGES = 300, 1000, 110 * 1024, 1000
#: Of a language's documents, hashes are let through for so many times ``LEARN_DOCS`` of them
SPARE = 4
LEVEL = 9
PIECE = 512              # bytes encoded together: longer pieces would learn from themselves, not the dictionary
MARGIN = 0.005           # a lead below this share of the size is too narrow to accept
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def plain_words(text: str) -> str:
    """Lower-case runs of letters; a word repeated on the spot counts once."""
    return " ".join(w for w, _ in groupby(_WORD.findall(text.lower())))


def _first(excerpts: DataFrame, limits: dict[str, int]) -> list[tuple[str, int, str]]:
    """(lang, n, text) of the first ``LEARN_DOCS`` excerpts of each language by hash, among hashes up to its limit: what
    travels to the task that ranks a language does not grow with the number of tasks."""
    if not limits:
        return []
    listed = excerpts.sparkSession.createDataFrame(list(limits.items()), "lang string, most bigint")
    low = excerpts.join(F.broadcast(listed), "lang").where("h <= most")
    best = Window.partitionBy("lang").orderBy("h", "text")
    ranked = low.withColumn("n", F.row_number().over(best)).where(F.col("n") <= LEARN_DOCS)
    return [(r["lang"], r["n"], r["text"]) for r in ranked.collect()]


def learn_languages(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
                    ) -> dict[str, bytes]:
    """Language -> raw-content dictionary, from a bounded sample of labelled rows: the excerpts of the first
    documents in the order of a hash of their ids, the languages with most rows first; each from a place that the hash chooses. Rows without language or text are not used."""
    labelled = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                         F.xxhash64(F.col(id_col)).alias("h")).where("lang is not null and text != ''")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    start = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - LEARN_CHARS))
    excerpts = labelled.select("lang", "h", F.col("text").substr(start.cast("int"), F.lit(LEARN_CHARS)).alias("text"))
    chosen = _first(excerpts, {r["lang"]: -(1 << 63) + int((1 << 64) * min(1.0, SPARE * LEARN_DOCS / r["count"])) - 1 for r in counts})
    scarce = [r["lang"] for r in counts if sum(lang == r["lang"] for lang, *_ in chosen) < min(LEARN_DOCS, r["count"])]
    if scarce:      # ids that share a hash: ranked without a threshold
        chosen = [row for row in chosen if row[0] not in scarce] + _first(excerpts, {lang: (1 << 63) - 1 for lang in scarce})
    texts: dict[str, list[str]] = {row["lang"]: [] for row in counts}
    for lang, _, text in sorted(chosen):
        texts[lang].append(plain_words(text))
    found = {lang: " ".join(t).encode()[:DICTIONARY_BYTES] for lang, t in texts.items()}
    return {lang: words for lang, words in found.items() if len(words) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.codecs = []
        for lang, content in dictionaries.items():      # in the order that decides ties
            learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(level=level)
            codec = zstandard.ZstdCompressor(level=level, dict_data=learned, write_content_size=False)
            self.codecs.append((lang, codec.compress))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(nearest language, score, whether the lead is wide enough)."""
        words = plain_words(text) if any(map(str.isalpha, text)) else ""
        if not words or not self.codecs:
            return UNDETERMINED, 0.0, False
        data = b" " + words.encode("utf-8", "surrogatepass")
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted(((sum(len(compress(p)) for p in pieces), lang) for lang, compress in self.codecs),
                       key=itemgetter(0))
        best, lang = sizes[0]
        if len(sizes) > 1 and sizes[1][0] == best and len(pieces) == 1:
            lang = self._by_words(words, {lang for size, lang in sizes if size == best})
        lead = (sizes[1][0] - best) if len(sizes) > 1 else best
        odds = sum(2.0 ** max(-200.0, (best - size) / 2) for size, _ in sizes)
        return lang, 1.0 / odds, lead >= max(1, MARGIN * best)

    def _by_words(self, words: str, among: set[str]) -> str:
        """Of languages that encode a short text equally small, the one that encodes its words smallest."""
        alone = [f" {w} ".encode("utf-8", "surrogatepass") for w in words.split()]
        return min(((sum(len(compress(w)) for w in alone), lang) for lang, compress in self.codecs if lang in among),
                   key=itemgetter(0))[1]


_classifiers: dict[tuple, Classifier] = {}      # the last model of this worker


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    claim_worker("language")
    key = tuple(model.value.items())
    if key not in _classifiers:
        _classifiers.clear()
        _classifiers[key] = Classifier(model.value)
    predict = _classifiers[key].predict
    for rows in rows_of(batches):
        lang, score, accepted = zip(*map(predict, rows.column("text").to_pylist()))
        yield pa.record_batch([rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                               pa.array(accepted, pa.bool_())], names=["doc_id", "lang", "score", "accepted"])


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, lang, score, accepted): whole texts are encoded in pieces with the dictionary of every language,
    and the smallest total wins. ``score`` is between 0 and 1, near 1 for a clear winner; ``accepted`` is false where
    the lead over the second language is narrow.

    Defined results: a text without a letter (missing, empty) is ``und``, score 0, not accepted, and so is every
    text if nothing was learned; ties of a short text go by its single words, other ties to the language with more
    learned rows, and are not accepted; rows may repeat. The dictionaries (at most 110 KB for each language) are
    broadcast; no row moves between tasks.
    """
    spark: SparkSession = df.sparkSession
    model = spark.sparkContext.broadcast(dict(dictionaries))
    return with_text(df, id_col, text_col).mapInArrow(
        partial(_predict, model=model), "doc_id bigint, lang string, score double, accepted boolean")
