"""Chunks: the rows of a table dealt by a hash into groups of bounded bytes.

Operators that need a corpus-wide answer about the words or windows of a text send compact
questions about a chunk as a whole, and get answers in the order of the questions. A chunk's
rows are shuffled once, compressed, and the exchange is reused by every later step, so texts
are moved once however many rounds of questions there are. A question is a function of the
chunk's content only; rows of a chunk are sorted before use, so the order of arrival is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import give_back, prepared, strings

CHUNK_BYTES = 8 << 20  # text in a chunk, about; a longer single text is a chunk of its own size


@dataclass
class Chunked:
    rows: DataFrame   # chunk int, doc_id long, packed binary
    chunks: int
    text_bytes: int


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, by_text: bool = False) -> Chunked:
    """``docs`` (doc_id, text) in chunks; null texts are empty ones. A document's rows share a chunk,
    or (``by_text``) only those of equal text, so that an id with many rows is spread."""
    docs = prepared(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                j = min(i + 1000, batch.num_rows)
                raw, off = strings(batch.column(1).slice(i, j - i))  # no second copy of the whole batch
                blobs = [compressor.compress(raw[a:b].tobytes()) for a, b in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(i, j - i), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(blobs, pa.binary())],
                    names=["chunk", "doc_id", "packed"])

    content = F.col("text") if by_text else F.when(F.col("doc_id").isNull(), F.col("text"))
    chunk = F.pmod(F.xxhash64("doc_id", content), F.lit(chunks)).cast("int")
    rows = docs.withColumn("chunk", chunk).mapInArrow(run, "chunk int, doc_id long, packed binary")
    return Chunked(rows.repartition(chunks, "chunk"), chunks, total)


def texts(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's texts sorted by id (null last) and content: ids, which are null, bytes, offsets."""
    if not group.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    give_back()  # what the chunk before left
    column = group.column("doc_id").combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    packed = group.column("packed").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (null[k], ids[k], packed[k]))
    decompressor = zstandard.ZstdDecompressor()
    parts = [decompressor.decompress(packed[k]) for k in order]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return ids[order], null[order], np.frombuffer(b"".join(parts), np.uint8), off


def id_array(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start[0] .. start[0] + length[0] - 1, then those of the next span, and so on."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - np.cumsum(length) + length, length)
