"""Token ids in binary files: patched frame-of-reference blocks.

File: magic, counts (documents, ids, blocks), document ids, ids per document, where each block starts, blocks.
Block of 128 ids: base (the minimum), width, number of exceptions, the low ``width`` bits of each difference,
positions and full differences of the exceptions. The width is that of a percentile of the differences.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.chunk_table import token_bytes
from tablewise.llm.common import claim_worker, rows_of, with_text
from tablewise.sources.staging import new_path, stage

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILE = 90
FILE_IDS = 4_000_000     # a file is closed behind the document that reaches this
MANIFEST = "part bigint, seq bigint, path string, n_docs bigint, n_ids bigint"
RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) of values below 2**width -> (rows, BLOCK * width / 8) of bytes, low bits first."""
    planes = [((values >> b) & 1).astype(np.uint8) for b in range(width)]
    return np.packbits(np.stack(planes, 1), axis=2, bitorder="little").reshape(len(values), -1)


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    planes = np.unpackbits(data.reshape(len(data), width, BLOCK // 8), axis=2, bitorder="little")
    out = np.zeros((len(data), BLOCK), np.uint32)
    for b in range(width):
        out |= planes[:, b].astype(np.uint32) << np.uint32(b)
    return out


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(start of each block and of the end, blocks). The last block is filled up with its own minimum."""
    if not len(ids):
        return np.zeros(1, "<u8"), b""
    n = -(-len(ids) // BLOCK)
    blocks = np.empty(n * BLOCK, np.uint32)
    blocks[:len(ids)] = ids
    blocks[len(ids):] = ids[(n - 1) * BLOCK:].min()
    blocks = blocks.reshape(n, BLOCK)
    base = blocks.min(1)
    over = blocks - base[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits(np.partition(over, at, axis=1)[:, at])
    outside = over >> width[:, None].astype(np.uint32) > 0
    outside[width >= 32] = False
    exceptions = outside.sum(1)
    sizes = 6 + width.astype(np.int64) * (BLOCK // 8) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(starts[-1], np.uint8)
    head = np.empty((n, 6), np.uint8)
    head[:, :4] = base.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = width, exceptions
    data[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            low = over[rows] & np.uint32((1 << int(w)) - 1)
            data[starts[rows, None] + 6 + np.arange(BLOCK // 8 * int(w))] = pack_bits(low, int(w))
    row, position = np.nonzero(outside)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
        at = starts[row] + 6 + width[row].astype(np.int64) * (BLOCK // 8)
        data[at + rank] = position
        data[(at + exceptions[row] + 4 * rank)[:, None] + np.arange(4)] = (
            over[row, position].astype("<u4").view(np.uint8).reshape(-1, 4))
    return starts.astype("<u8"), data.tobytes()


def decode_blocks(starts: np.ndarray, data: np.ndarray, n_ids: int, first: int = 0, last: int | None = None
                  ) -> np.ndarray:
    """The ids of the blocks ``first`` up to ``last`` (all by default), found by the index of block starts."""
    n = len(starts) - 1
    last = n if last is None else last
    if last <= first:
        return np.zeros(0, np.uint32)
    at = starts[first:last].astype(np.int64)
    head = data[at[:, None] + np.arange(6)]
    base = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1)
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[rows] = unpack_bits(data[at[rows, None] + 6 + np.arange(BLOCK // 8 * w)], int(w))
    if exceptions.any():
        row = np.repeat(np.arange(len(exceptions)), exceptions)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        begin = at[row] + 6 + width[row] * (BLOCK // 8)
        values = np.ascontiguousarray(data[(begin + exceptions[row] + 4 * rank)[:, None] + np.arange(4)])
        out[row, data[begin + rank]] = values.view("<u4").reshape(-1)
    out += base[:, None]
    return out.reshape(-1)[:min(n_ids, last * BLOCK) - first * BLOCK]


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that a value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    head = np.array([len(doc_ids), len(ids), len(starts) - 1], "<u8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
                     starts.tobytes(), blocks])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids) of a file's bytes."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, n_blocks = np.frombuffer(data, "<u8", 3, 8).tolist()
    at = 32
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 4 * n_docs)
    blocks = np.frombuffer(data, np.uint8, -1, at + 8 * (n_blocks + 1))
    return doc_ids, counts, decode_blocks(starts, blocks, n_ids)


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, spaces: bool, end_id: int, folder: str, file_ids: int,
           special: bool) -> Iterator[pa.RecordBatch]:
    """Write the documents of a partition, in their order; one row for each file. The names are new for each
    attempt of a task: only those that the manifest lists count."""
    claim_worker("token_files")
    system, root = _filesystem(folder)
    part, seq = TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    doc_ids: list[int] = []
    coded: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        counts = np.array([len(c) // 4 for c in coded], np.int64)
        path = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.pfor"
        with system.open_output_stream(f"{root}/{path}") as out:
            out.write(file_bytes(np.array(doc_ids, np.int64), counts, np.frombuffer(b"".join(coded), "<u4")))
        values = part, seq, path, len(doc_ids), int(counts.sum())
        return pa.record_batch([pa.array([v]) for v in values], names=["part", "seq", "path", "n_docs", "n_ids"])

    for rows in rows_of(batches):
        doc_ids += rows.column("doc_id").to_pylist()
        coded += (found := [c + end for c in token_bytes(rows.column("text").to_pylist(), tokenizer, spaces, special)])
        size += sum(map(len, found)) // 4
        if size >= file_ids:
            yield close()
            doc_ids, coded, size, seq = [], [], 0, seq + 1
    if doc_ids:
        yield close()


def write_token_files(df: DataFrame, tokenizer: str, folder: str, spaces: bool = False, end_id: int = 2,
                      file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text", special: bool = False
                      ) -> DataFrame:
    """Write the ids of all documents in ascending order of doc_id; the manifest of the files, staged.

    Ranges of doc_id go to tasks, each sorts its own and writes files of about ``file_ids`` ids. ``folder`` is a
    URI that pyarrow can write (file, hdfs, s3, gs). Manifest: part, seq (together the order of the files), path,
    n_docs, n_ids. Rows without doc_id have no place in the order and are left out; equal ones go by their text.
    """
    rows = with_text(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    write = partial(_write, tokenizer=tokenizer, spaces=spaces, end_id=end_id, folder=folder, file_ids=file_ids,
                    special=special)
    return stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = _filesystem(folder)
    for files in batches:
        for path, first in zip(files.column("path").to_pylist(), files.column("first").to_pylist()):
            with system.open_input_stream(f"{root}/{path}") as source:
                doc_ids, counts, ids = read_file(source.read())
            ends = np.cumsum(counts, dtype=np.int64)
            ids = np.ascontiguousarray(ids, "<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.record_batch([pa.array(doc_ids), pa.array(first + ends - counts), pa.array(counts, pa.int64()),
                                   pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest; ``start`` counts the ids of all
    documents before. The running sum goes over one row per file, not per document."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")
    files = manifest.select("path", first)
    # a number of its own, or the few bytes of the manifest would make one task that reads every file
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(partial(_read, folder=folder), RESULT)


def token_digest(df: DataFrame, tokenizer: str, spaces: bool = False, end_id: int = 2, special: bool = False) -> DataFrame:
    """Write the ids of all documents to files in the shared folder, read the files back.

    Defined results: a missing text is an empty one (the end id alone); rows without doc_id are left out; an
    empty table writes no file and gives no rows.
    """
    folder = new_path(df.sparkSession, "token-files")
    manifest = write_token_files(df, tokenizer, folder, spaces, end_id, special=special)
    return read_token_files(manifest, folder)
