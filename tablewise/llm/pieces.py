"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewise.llm.chunk_table import ChunkTable
from tablewise.llm.common import claim_worker, rows_of, with_text, worker_cache

MARK = "\u2581"
_FIRST_MARKED = re.compile(f"[ {MARK}]([ {MARK}]*[^ {MARK}]*)")     # a marked word without its first marker


@functools.lru_cache(maxsize=4)
def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def words_are_independent(processor) -> bool:
    """Whether marked words can be segmented one by one: no piece has a marker behind another character, and
    the model neither changes characters nor white space but for the marker it puts before a text."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = "\ufb01  x \u2460\tY\n e\u0301  "
    return (not any(MARK in p.lstrip(MARK) for p in pieces)
            and processor.normalize(probe) == MARK + probe.replace(" ", MARK))


@worker_cache(maxsize=2)
def _word_table(path: str) -> ChunkTable | None:
    """Marked word, without its first marker -> ids as bytes. The processor puts the first marker back."""
    processor = _processor(path)
    if not words_are_independent(processor):
        return None
    alone = [processor.piece_to_id(MARK)]      # a marker at the end of a text
    return ChunkTable(lambda word: processor.encode(word) if word else alone)


def piece_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as unsigned 32-bit little-endian integers, without begin and end."""
    table = _word_table(path)
    if table is None:
        return [np.array(i, "<u4").tobytes() for i in _processor(path).encode(texts, num_threads=1)]
    return [table.ids(_FIRST_MARKED.findall(" " + t) if t else []) for t in texts]


def _encode(batches: Iterator[pa.RecordBatch], path: str, ends: bool, decode: bool) -> Iterator[pa.RecordBatch]:
    claim_worker("pieces")
    processor = _processor(path)
    begin, end = (np.array([i], "<u4").tobytes() if ends else b"" for i in (processor.bos_id(), processor.eos_id()))
    for rows in rows_of(batches):
        coded = [begin + c + end for c in piece_bytes(rows.column("text").to_pylist(), path)]
        columns = [rows.column("doc_id"), pa.array(coded, pa.binary())]
        if decode:
            columns.append(pa.array(_decoded(coded, processor), pa.string()))
        yield pa.record_batch(columns, names=["doc_id", "ids", "decoded"][:len(columns)])


def _decoded(coded: list[bytes], processor) -> list[str]:
    return [processor.decode(np.frombuffer(c, "<u4").tolist()) for c in coded]


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        text = [None if c is None else _decoded([c], _processor(path))[0] for c in rows.column("ids").to_pylist()]
        yield pa.record_batch([rows.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])


def encode_pieces(df: DataFrame, model: str, ends: bool = True, decode: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, [decoded]): ``ids`` are unsigned 32-bit little-endian integers, equal to those of the library.

    A text is split before every run of markers. If no piece of the model crosses one, each distinct marked word
    is segmented once and the ids are joined back by position; otherwise whole texts are encoded. The table of
    words belongs to a Python worker and is bounded: joining 10^8 words with a table of the whole corpus would
    move several times the corpus through a shuffle, to save what takes a few microseconds per new word.

    Defined results: a missing text is an empty one, which has the begin and end ids only; rows may repeat; an
    empty table gives no rows. No row moves between tasks.
    """
    schema = "doc_id bigint, ids binary" + ", decoded string" * decode
    return with_text(df, id_col, text_col).mapInArrow(partial(_encode, path=model, ends=ends, decode=decode), schema)


def decode_pieces(df: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) as ``encode_pieces`` gives them; missing ids give a missing text."""
    return df.select("doc_id", "ids").mapInArrow(partial(_decode, path=model), "doc_id bigint, text string")
