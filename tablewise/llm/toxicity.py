"""Toxic passages: maximum-scoring segments over the log-odds of tokens.

Learning counts, for each token and each token prefix, the toxic and the other documents that hold it. The log-odds
ratio of the two under a Dirichlet prior is kept, of either sign, where it differs from zero significantly. In a text
every token scores its own log-odds less ``DRIFT``, the prior odds against a toxic passage. All maximum-scoring segments of a
document are found by one linear scan, their scores are compared with the extreme-value distribution that clean text
gives, and the evidence of the significant ones is added up. The line from evidence to probability is cross-fitted:
each labelled document is scored with weights that were learned without it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import claim_worker, rows_of, small, with_text
from tablewise.llm.grams import LETTER, LOWER, hash_spans, layout, mix, spans
from tablewise.sources.staging import stage

#: Token levels: prefixes of so many bytes, and the whole token (0). The longest level that is significant counts.
LEVELS = (4, 6, 0)
FOLDS = (0, 1)              # of the labelled documents, for the line
PRIOR = 0.1                 # weight of the prior, as a share of the counted tokens
SIGNIFICANT = 3.5           # least z-score of log-odds that speak for toxicity
AGAINST = 2.0               # and of log-odds that speak against it
DRIFT = 0.5                 # what every token takes off a segment
MOST_WEIGHT = 6.0           # log-odds are cut at this size, either sign
BROADCAST_WEIGHTS = 2_000_000   # 32 MB; a larger model is joined by shuffle
COUNTED_TOGETHER = 2_000_000

COUNTS = "level int, h bigint, other0 bigint, toxic0 bigint, other1 bigint, toxic1 bigint"
CLASSES = ("other0", "toxic0", "other1", "toxic1")
SCORED = ("doc_id bigint, n_tokens bigint, evidence double, "
          "passages array<struct<start:bigint,end:bigint,score:double,evidence:double>>")
PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                               ("evidence", pa.float64())]))


@dataclass
class Weights:
    """Log-odds of tokens by hash (ascending, one array for each level)."""

    hashes: list[np.ndarray]
    values: list[np.ndarray]


@dataclass
class Model:
    """The significant log-odds as a table (level, h, weight, other) and, up to ``BROADCAST_WEIGHTS`` of them, as arrays;
    the scale of the extreme-value distribution."""

    table: DataFrame
    weights: Weights | None
    scale: float


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, first, hashes for each level) of the runs of letters; ASCII letters in lower case."""
    data, bounds = layout(column)
    starts, ends, first = spans(data, bounds, LETTER)
    lower = LOWER[data]
    levels = []
    for size in LEVELS:
        stop = np.minimum(ends, starts + size) if size else ends
        levels.append(mix(hash_spans(lower, starts, stop) + np.uint64(size)))
    return starts, ends, first, levels


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document counts each of its tokens and prefixes once. The totals of level i come as level -1 - i."""
    claim_worker("toxicity")
    waiting: list[list[tuple[np.ndarray, int]]] = [[] for _ in LEVELS]
    size, totals = 0, np.zeros((len(LEVELS), len(CLASSES)), np.int64)

    def counted() -> Iterator[pa.RecordBatch]:
        for level, parts in enumerate(waiting):
            if parts:
                h, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                of = np.repeat([p[1] for p in parts], [len(p[0]) for p in parts])
                sums = [np.bincount(place[of == c], minlength=len(h)).astype(np.int64) for c in range(len(CLASSES))]
                yield pa.record_batch([pa.array(np.full(len(h), level, np.int32)), pa.array(h.view(np.int64)),
                                       *map(pa.array, sums)], names=["level", "h", *CLASSES])

    for rows in rows_of(batches):
        _, _, first, levels = tokens(rows.column("text"))
        classes = [2 * f + t for f, t in zip(rows.column("fold").to_pylist(), rows.column("toxic").to_pylist())]
        for i, c in enumerate(classes):
            for level, h in enumerate(levels):
                value = np.unique(h[first[i]:first[i + 1]])
                waiting[level].append((value, c))
                totals[level, c] += len(value)
                size += len(value)
        if size > COUNTED_TOGETHER:
            yield from counted()
            waiting, size = [[] for _ in LEVELS], 0
    yield from counted()
    yield pa.record_batch([pa.array(-1 - np.arange(len(LEVELS), dtype=np.int32)), pa.array(np.zeros(len(LEVELS), np.int64)),
                           *(pa.array(totals[:, c].copy()) for c in range(len(CLASSES)))], names=["level", "h", *CLASSES])


def log_odds(toxic: Column, other: Column, toxic_total: Column, other_total: Column) -> tuple[Column, Column]:
    """(log-odds ratio, its z-score) with a Dirichlet prior proportional to the frequency in both classes."""
    prior = (toxic + other) * F.lit(PRIOR)
    mass = F.lit(PRIOR) * F.greatest(F.lit(1), toxic_total + other_total)

    def odds(n: Column, of: Column) -> Column:
        return F.log((n + prior) / (of + mass - n - prior + F.lit(1e-9)))

    ratio = odds(toxic, toxic_total) - odds(other, other_total)
    return ratio, ratio / F.sqrt(F.lit(1.0) / (toxic + prior) + F.lit(1.0) / (other + prior))


def scale_of(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(share * exp(scale * weight)) = 1 over the tokens of clean text; tokens without
    log-odds of their own have the remaining share and weigh -DRIFT."""
    rest = max(1e-9, 1.0 - float(shares.sum()))

    def excess(scale: float) -> float:
        return float((shares * np.exp(np.minimum(600.0, scale * weights))).sum()) + rest * math.exp(-scale * DRIFT) - 1.0

    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def count_tokens(train: DataFrame) -> DataFrame:
    """From (text, toxic, fold): counts over all rows by level, hash, fold and class, written."""
    return stage(train.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))
                 .mapInArrow(_count, COUNTS).groupBy("level", "h").agg(*[F.sum(c).alias(c) for c in CLASSES]),
                 "token-counts")


def learn_weights(counts: DataFrame, folds: tuple[int, ...] = FOLDS) -> Model:
    """The model that the documents of ``folds`` give."""
    toxic, other = (reduce(Column.__add__, [F.col(f"{c}{f}") for f in folds]) for c in ("toxic", "other"))
    counts = counts.select("level", "h", toxic.alias("toxic"), other.alias("other"))
    totals = {-1 - r["level"]: (r["toxic"], r["other"]) for r in counts.where("level < 0").collect()}

    def total(which: int) -> Column:
        return F.element_at(F.array(*[F.lit(totals.get(i, (0, 0))[which]) for i in range(len(LEVELS))]), F.col("level") + 1)

    ratio, z = log_odds(F.col("toxic"), F.col("other"), total(0), total(1))
    weight = F.greatest(F.lit(-MOST_WEIGHT), F.least(ratio, F.lit(MOST_WEIGHT)))
    # a token of the other folds only has no counts, so its log-odds are NaN
    table = counts.where("level >= 0 and toxic + other > 0").select("level", "h", weight.alias("weight"), "other", z.alias("z")).where(
        (F.col("z") >= SIGNIFICANT) | (F.col("z") <= -AGAINST)).drop("z")
    whole = LEVELS.index(0)
    bins = table.where(F.col("level") == whole).groupBy(F.round("weight", 2).alias("weight")).agg(
        F.sum(F.col("other") + F.when(F.col("weight") > 0, 0.5).otherwise(0.0)).alias("n")).collect()
    of_clean = max(1, totals.get(whole, (0, 0))[1])
    scale = scale_of(np.array([r["weight"] for r in bins]) - DRIFT, np.array([r["n"] for r in bins]) / of_clean)
    if table.count() > BROADCAST_WEIGHTS:
        return Model(table, None, scale)
    return Model(table, _arrays(table.select("level", "h", "weight").toArrow()), scale)


def _arrays(table: pa.Table) -> Weights:
    """From (level, h, weight); of repeated rows one."""
    level = table.column("level").to_numpy()
    h, weight = table.column("h").to_numpy().view(np.uint64), table.column("weight").to_numpy()
    hashes, values = [], []
    for i in range(len(LEVELS)):
        known, at = np.unique(h[level == i], return_index=True)
        hashes.append(known)
        values.append(weight[level == i][at])
    return Weights(hashes, values)


def token_scores(levels: list[np.ndarray], weights: Weights) -> np.ndarray:
    """The score of each token: the log-odds of its longest level that has some, less the drift."""
    out = np.zeros(len(levels[0]))
    for h, known, values in zip(levels, weights.hashes, weights.values):
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            out = np.where(known[at] == h, values[at], out)
    return out - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sequence of scores, in linear time.

    ``below`` of a kept segment is the nearest earlier one whose sum before it is smaller. The search for the segment
    to merge with follows these links, so that what it passes over once is never looked at again.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(np.asarray(scores) > 0)
    first: list[int] = []
    last: list[int] = []
    before: list[float] = []
    with_: list[float] = []
    below: list[int] = []
    for place, start, end in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        begin, j = place, len(before) - 1
        while True:
            while j >= 0 and before[j] >= start:
                j = below[j]
            if j < 0 or with_[j] >= end:
                break
            begin, start, link = first[j], before[j], below[j]
            for kept in (first, last, before, with_, below):
                del kept[j:]
            j = link
        for kept, value in ((first, begin), (last, place), (before, start), (with_, end), (below, j)):
            kept.append(value)
    return [(a, b, w - v) for a, b, v, w in zip(first, last, before, with_)]


def _score_rows(rows: pa.RecordBatch, weights: Weights, scale: float) -> pa.RecordBatch:
    starts, ends, first, levels = tokens(rows.column("text"))
    scores = token_scores(levels, weights)
    _, bounds = layout(rows.column("text"))
    evidence, passages = [], []
    for i in range(len(rows)):
        own, n = [], max(1, int(first[i + 1] - first[i]))
        for a, b, score in segments(scores[first[i]:first[i + 1]]):
            # of n tokens of clean text, exp(-x) segments reach this score by chance
            x = scale * score - math.log(n)
            if x > 0:
                own.append({"start": int(starts[first[i] + a] - bounds[i]),
                            "end": int(ends[first[i] + b] - bounds[i]), "score": score, "evidence": x})
        passages.append(own)
        evidence.append(sum(p["evidence"] for p in own))
    return pa.record_batch([rows.column("doc_id"), pa.array(np.diff(first)), pa.array(evidence, pa.float64()),
                            pa.array(passages, PASSAGES)], names=["doc_id", "n_tokens", "evidence", "passages"])


def _score(batches: Iterator[pa.RecordBatch], weights: Broadcast, scale: float) -> Iterator[pa.RecordBatch]:
    claim_worker("toxicity")
    for rows in rows_of(batches):
        yield _score_rows(rows, weights.value, scale)


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, evidence, passages) of (doc_id, text): every significant toxic passage as a byte range."""
    if model.weights is None:
        return _find_by_shuffle(docs, model)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    return docs.select("doc_id", "text").mapInArrow(partial(_score, weights=weights, scale=model.scale), SCORED)


# --- a model too large for a broadcast ------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for k, rows in enumerate(rows_of(batches)):
        yield pa.record_batch([rows.column("doc_id"), rows.column("text"), pa.array(np.full(len(rows), part + k))],
                              names=["doc_id", "text", "chunk"])


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different tokens of each chunk."""
    for rows in rows_of(batches):
        _, _, first, levels = tokens(rows.column("text"))
        chunk = np.repeat(rows.column("chunk").to_numpy(), np.diff(first))
        for c in np.unique(chunk):
            for level, h in enumerate(levels):
                value = np.unique(h[chunk == c]).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(value), c)), pa.array(np.full(len(value), level, np.int32)),
                                       pa.array(value)], names=["chunk", "level", "h"])


def _score_chunk(docs: pa.Table, weights: pa.Table, scale: float) -> pa.Table:
    claim_worker("toxicity")
    own = _arrays(weights)
    return pa.Table.from_batches([_score_rows(rows, own, scale) for rows in rows_of(docs.to_batches())],
                                 pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("evidence", pa.float64()),
                                            ("passages", PASSAGES)]))


def _find_by_shuffle(docs: DataFrame, model: Model) -> DataFrame:
    """Documents are written in chunks of some 2 MB (or one document); each chunk is given the weights of its own tokens."""
    chunks = stage(docs.select("doc_id", "text").mapInArrow(_number, "doc_id bigint, text string, chunk bigint"), "chunks")
    weights = chunks.select("text", "chunk").mapInArrow(_used, "chunk bigint, level int, h bigint").join(
        model.table.select("level", "h", "weight"), ["level", "h"]).select("chunk", "level", "h", "weight")
    return chunks.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(
        partial(_score_chunk, scale=model.scale), SCORED)


def fit_line(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression on (evidence, toxic, other) counts, with a weak pull to zero; (intercept, slope)."""
    if not bins:
        return 0.0, 0.0
    x = np.array([b[0] for b in bins], float)
    toxic, n = np.array([b[1] for b in bins], float), np.array([b[1] + b[2] for b in bins], float)
    design = np.stack([np.ones_like(x), x], 1)
    line = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        gradient = design.T @ (toxic - n * p) - 1e-3 * line
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        line += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(line[0]), float(line[1])


def score_toxicity(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """(doc_id, score, n_tokens, evidence, passages) of every document.

    ``labels`` (id_col, label_col 0/1) give the classes; only rows where ``train``, an expression of id_col, holds
    are learned from, and nothing but the text decides a score.

    Defined results: a missing or empty text has no evidence and the score of a document without any; of several
    labels of one id the largest holds, a missing label is none; without any label every score is 0.5; repeated rows
    are scored each; an empty table gives no rows. Counts cover all labelled rows and every significant weight is used: up to
    ``BROADCAST_WEIGHTS`` by broadcast, beyond by a shuffled join.
    """
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(train)
    known = stage(given.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max(label_col).cast("int").alias("toxic"),
        F.pmod(F.xxhash64(F.first(id_col)), F.lit(len(FOLDS))).cast("int").alias("fold")), "labels")
    docs = with_text(df, id_col, text_col)
    learned_from = docs.join(small(known), "doc_id")
    counts = count_tokens(learned_from)
    # The line: every labelled document is scored by the model of the other fold.
    unseen = reduce(DataFrame.unionAll, [
        find_passages(learned_from.where(F.col("fold") == f), learn_weights(counts, tuple(x for x in FOLDS if x != f)))
        for f in FOLDS])
    place = F.least(F.round(F.col("evidence") * 4), F.lit(400.0)).alias("place")
    bins = unseen.select("doc_id", "evidence").join(small(known), "doc_id").groupBy(place).agg(
        F.sum("toxic").alias("toxic"), F.sum(F.lit(1) - F.col("toxic")).alias("other")).collect()
    intercept, slope = fit_line([(r["place"] / 4, r["toxic"], r["other"]) for r in bins])
    line = F.lit(intercept) + F.lit(slope) * F.least("evidence", F.lit(100.0))
    scored = find_passages(docs, learn_weights(counts))
    return scored.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-line))).alias("score"), "n_tokens", "evidence",
                         "passages")
