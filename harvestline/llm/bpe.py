"""BPE encoding and decoding through a table of distinct words.

A text splits at ASCII white space, which no token crosses, so a text's ids are those of its
words in order. Each chunk asks for its distinct words; the questions of all chunks meet by word,
each distinct word is encoded once, and the ids go back to the chunks, where they are put at the
positions of the words. Decoding looks every id up in the id-to-piece table of the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from harvestline.llm import vectext as vt
from harvestline.llm.chunks import CHUNK_BYTES, chunked, id_array, pack, ragged, texts, unpack
from harvestline.llm.common import give_back, slices

VOCABULARY = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    """The tokenizer of a vocabulary file (default: the public one named above), without
    truncation and padding. A file outside an installed package must be readable by all executors."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    loaded = Tokenizer.from_file(str(path))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def piece_table(path: str | None) -> pa.Array:
    """Id to piece with a blank behind it, as decoding joins them."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        pieces[at] = piece + " "
    return pa.array([p.encode() for p in pieces], pa.large_binary())


def distinct_words(raw: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """For a chunk: word offsets per text, the distinct word at each position, the distinct words
    and their hashes, in order of the hashes. Texts are taken about ``size`` bytes at a time, so
    that only a number per word and the distinct words are held for the whole chunk. Two independent
    hashes tell words apart; if words ever share one of them but not the other, other hash functions
    are taken."""
    for bank in range(20, 40, 2):
        word_off, hashes, unique, check, words = [np.zeros(1, np.int64)], [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, object)
        apart = True
        for i, j in slices(off, size):
            part = raw[off[i]:off[j]]
            start, end, of = vt.words(part, off[i:j + 1] - off[i])
            h, second = vt.span_hashes(part, start, end, bank), vt.span_hashes(part, start, end, bank + 1)
            mine, first = np.unique(h, return_index=True)
            apart = apart and bool((second == second[first][np.searchsorted(mine, h)]).all())
            at = np.searchsorted(unique, mine)
            known = unique[np.minimum(at, len(unique) - 1)] == mine if len(unique) else np.zeros(len(mine), bool)
            apart = apart and bool((check[at[known]] == second[first][known]).all())
            new, first = ~known, first[~known]
            found = np.empty(len(first), object)
            found[:] = [part[a:b].tobytes() for a, b in zip(start[first], end[first])]
            unique, check, words = np.insert(unique, at[new], mine[new]), np.insert(check, at[new], second[first]), np.insert(words, at[new], found)
            word_off.append(of[1:] + word_off[-1][-1])
            hashes.append(h)
        if apart:
            break
    for k, h in enumerate(hashes):
        hashes[k] = np.searchsorted(unique, h).astype(np.int32)
    return np.concatenate(word_off), np.concatenate(hashes) if hashes else np.zeros(0, np.int32), words.tolist(), unique


def questions(words: list[bytes], buckets: int) -> list[np.ndarray]:
    """Places of the distinct words in each bucket, sorted by word. The bucket follows from the
    word alone, by a hash that is the same in every chunk."""
    data = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    bucket = vt.span_hashes(data, off[:-1], off[1:], 9) % np.uint64(buckets)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    return [order[bucket[order] == b] for b in range(buckets)]


def encode_words(rows: DataFrame, path: str | None) -> DataFrame:
    """Answers (chunk, bucket, ids) to questions (bucket, chunk, words): every distinct word of a
    bucket is encoded once. An answer holds the number of ids of each word, then all ids. Buckets
    come one after the other, so a task remembers the words of one only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known, current = tokenizer(path), {}, None
        for batch in batches:
            for bucket, chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    known, current = {}, bucket
                words = unpack(blob).decode().split("\n")
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 10_000):
                    part = new[at:at + 10_000]
                    known.update(zip(part, (np.array(e.ids, "<u4") for e in encoder.encode_batch(part, add_special_tokens=False))))
                ids = [known[w] for w in words]
                counts = np.array([len(i) for i in ids], "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([bucket], pa.int32()), pa.array([pack(counts.tobytes() + np.concatenate(ids).astype("<u4").tobytes())])],
                    names=["chunk", "bucket", "ids"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk int, bucket int, ids binary")


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, the SHA-256 of the ids and of the text
    decoded from them, and (``with_ids``) the ids. A null or empty text has no ids and decodes to
    the empty text; a null doc_id stays null; repeated rows are encoded each."""
    chunks = chunked(docs, chunk_bytes, by_text=True)
    buckets = 8 * int(np.ceil(np.sqrt(chunks.chunks)))

    def ask(group: pa.Table) -> pa.Table:
        _, _, raw, off = texts(group)
        words = distinct_words(raw, off)[2]
        asked = [(b, pack(b"\n".join(words[k] for k in places))) for b, places in enumerate(questions(words, buckets)) if len(places)]
        del words, raw, off
        give_back()
        chunk = group.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in asked], pa.int32()), "chunk": pa.array([chunk] * len(asked), pa.int32()),
                         "words": pa.array([w for _, w in asked], pa.binary())})

    answers = encode_words(chunks.rows.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, words binary"), path)

    def place(group: pa.Table, answer: pa.Table) -> pa.Table:
        ids, null, raw, off = texts(group)
        word_off, inverse, words, _ = distinct_words(raw, off)
        count, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        asked, tables, at = questions(words, buckets), [], 0
        for bucket, blob in zip(answer.column("bucket").to_pylist(), answer.column("ids").to_pylist()):
            places, data = asked[bucket], np.frombuffer(unpack(blob), "<u4")
            n = data[:len(places)].astype(np.int64)
            count[places], first[places] = n, at + np.cumsum(n) - n
            tables.append(data[len(places):])
            at += len(data) - len(places)
        table = np.concatenate(tables) if tables else np.zeros(0, "<u4")
        pieces = piece_table(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        step = 256
        for i in range(0, len(ids), step):
            j = min(i + step, len(ids))
            mine = inverse[word_off[i]:word_off[j]]
            flat = table[ragged(first[mine], count[mine])]
            end = np.concatenate([[0], np.cumsum(count[mine])])[word_off[i:j + 1] - word_off[i]]
            decoded = pc.take(pieces, pa.array(flat.astype(np.int64)))
            piece_off = np.frombuffer(decoded.buffers()[1], np.int64)[decoded.offset:decoded.offset + len(decoded) + 1] if len(flat) else np.zeros(1, np.int64)
            data = memoryview(decoded.buffers()[2]) if len(flat) else memoryview(b"")
            for a, b in zip(end, end[1:]):
                out["n_tokens"].append(b - a)
                out["ids_sha256"].append(hashlib.sha256(flat[a:b].tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data[piece_off[a]:max(piece_off[b] - 1, piece_off[a])]).hexdigest())
                if with_ids:
                    out["ids"].append(flat[a:b].astype(np.int32))
        del word_off, inverse, words, table, tables, count, first, raw, off, asked
        give_back()
        columns = {"doc_id": id_array(ids, null), "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                   "ids_sha256": pa.array(out["ids_sha256"], pa.string()), "decoded_sha256": pa.array(out["decoded_sha256"], pa.string())}
        if with_ids:
            columns["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
        return pa.table(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return chunks.rows.groupBy("chunk").cogroup(answers.repartition(chunks.chunks, "chunk").groupBy("chunk")).applyInArrow(place, schema)
