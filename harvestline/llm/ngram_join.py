"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles; equal sets form one class, told by a 128-bit digest, and
its smallest id stands for it. In the order of rising frequency two sets that are similar share
their first l common tokens within their l-prefixes, which are n - ceil(t * n) + l tokens long. So
a pair is a candidate only if it shares l tokens there, with l the smaller of what its members
chose. Each document chooses its l by estimated cost: the lists its prefix reads, and the sets to
be verified, at most the sum of these lists over l, as a candidate shows up in l of them.

Frequencies are counted over all classes. Texts are dealt once to chunks; a chunk sends the hashes
of its tokens to slices of the hash space, packed, and gets their counts back in the same order. A
message holds a chunk's tokens of one slice, so there are never more than there are tokens.

Lists are not expanded to all pairs: every member meets its list's pivot, and those that this
leaves in other components meet only where the first shared token can be (``prefixes``). Candidates
are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from harvestline.llm import vectext as vt
from harvestline.llm.chunks import CHUNK_BYTES
from harvestline.llm.common import pieces, prepared, slices as row_slices, stored
from harvestline.llm.graph import components
from harvestline.llm.near_dups import resolved, shingles, verified
from harvestline.llm.prefixes import needed, pairs_across, stars, useful

U = np.uint64
MOST = 16  # longest extension of a prefix


def digests(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set; 0 for an empty one."""
    out, full = [], np.flatnonzero(np.diff(at) > 0)
    for salt in (11, 12):
        total = np.zeros(len(at) - 1, np.uint64)
        if len(full):
            total[full] = np.add.reduceat(vt.mix(value + U(salt)), at[:-1][full])
        out.append(total.view(np.int64))
    return out


def chunk_of(d1: np.ndarray, ids: np.ndarray, chunks: int) -> np.ndarray:
    return (vt.mix(d1.view(np.uint64) ^ vt.mix(ids.view(np.uint64))) % U(chunks)).astype(np.int32)


def signed_sets(docs: DataFrame, size: int, chunks: int) -> DataFrame:
    """doc_id, n, d1, d2 and the chunk of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches):
            value, at = shingles(raw, off, size)
            d1, d2 = digests(value, at)
            ids = rows.column(0).cast(pa.int64())
            chunk = chunk_of(d1, ids.fill_null(0).to_numpy(zero_copy_only=False), chunks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at).astype(np.int64)), pa.array(d1), pa.array(d2), pa.array(chunk)],
                                             names=["doc_id", "n", "d1", "d2", "chunk"])

    return prepared(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, chunk int")


def packed_sets(docs: DataFrame, size: int, chunks: int) -> DataFrame:
    """chunk, doc_id, d1 and the compressed text of the rows with an id and a shingle. Rows that
    repeat within a piece of a batch are sent once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for rows, raw, off in pieces(batches):
            value, at = shingles(raw, off, size)
            d1 = digests(value, at)[0]
            valid = rows.column(0).is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0)
            ids = rows.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(valid)
            mine = mine[np.unique(np.stack([ids[mine], d1[mine]], 1), axis=0, return_index=True)[1]]
            blobs = [compressor.compress(raw[off[k]:off[k + 1]].tobytes()) for k in mine]
            yield pa.RecordBatch.from_arrays([pa.array(chunk_of(d1[mine], ids[mine], chunks)), pa.array(ids[mine]), pa.array(d1[mine]), pa.array(blobs, pa.binary())],
                                             names=["chunk", "doc_id", "d1", "packed"])

    return prepared(docs, "doc_id", "text").mapInArrow(run, "chunk int, doc_id long, d1 long, packed binary").repartition(chunks, "chunk")


def chosen_sets(rows: pa.Table, reps: set[tuple[int, int]], size: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of a chunk's rows those that stand for a class, by id: ids, compressed texts, all their
    shingles, and the offsets of each text's."""
    found: dict[tuple[int, int], bytes] = {}
    for key, blob in zip(zip(rows.column("doc_id").to_pylist(), rows.column("d1").to_pylist()), rows.column("packed")):
        if key in reps and key not in found:
            found[key] = blob.as_py()
    keys = sorted(found)
    blobs, unpack = [found[k] for k in keys], zstandard.ZstdDecompressor().decompress
    lengths = np.concatenate([[0], np.cumsum([zstandard.frame_content_size(b) for b in blobs])]).astype(np.int64)
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in row_slices(lengths):
        value, at = shingles(np.frombuffer(b"".join(map(unpack, blobs[i:j])), np.uint8), lengths[i:j + 1] - lengths[i], size)
        values.append(value)
        counts.append(np.diff(at))
    return np.array([k[0] for k in keys], np.int64), blobs, np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def coded(value: np.ndarray, slices: int) -> np.ndarray:
    """A token's slice of the hash space, and below it 32 bits of its hash. Tokens that fall on one
    code are counted together: their frequency is too high, but the order stays one for all sets."""
    return ((value >> U(32)) % U(slices)) << U(32) | value & U(0xFFFFFFFF)


def zipped(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())


def unzipped(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")


def prefix_choice(n: np.ndarray, at: np.ndarray, cost: np.ndarray, percent: int) -> np.ndarray:
    """For each set the number l of matches to ask for: the one of least estimated cost. ``cost`` is
    the running sum, with a leading 0, of what the tokens' lists hold besides the set itself."""
    least = -(-percent * n // 100)
    best, choice = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for extra in range(1, MOST + 1):
        read = cost[at[:-1] + np.minimum(n - least + extra, n)] - cost[at[:-1]]
        total = np.where(extra <= least, read + read / extra * n, np.inf)
        better = total < best
        best[better], choice[better] = total[better], extra
    return choice


QUESTION = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PREFIX = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("matches", pa.int64()), ("first", pa.int64()), ("tokens", pa.list_(pa.int64())), ("packed", pa.binary())])


def prefixes(docs: DataFrame, classes: DataFrame, size: int, percent: int, chunks: int) -> DataFrame:
    """For each class whose 1-prefix has a token of another class: its adaptive prefix. ``first``
    is the position of the first of ``tokens``; those before it are its own only."""
    slices = chunks
    rows = packed_sets(docs, size, chunks)
    empty = [F.lit(None).cast("binary").alias("counts")]
    reps = classes.select("chunk", F.lit(-1).alias("slice"), F.col("node").alias("doc_id"), "d1", *empty)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return QUESTION.empty_table()
        wanted = set(zip(right.column("doc_id").to_pylist(), right.column("d1").to_pylist()))
        _, _, value, _ = chosen_sets(left, wanted, size)
        code, n = np.unique(coded(value, slices), return_counts=True)
        part = (code >> U(32)).astype(np.int32)
        new = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(new[1:], len(code))
        return pa.table({"slice": pa.array(part[new]), "chunk": pa.array(np.full(len(new), right.column("chunk")[0].as_py(), np.int32)),
                         "keys": pa.array([(code[i:j] & U(0xFFFFFFFF)).astype("<u4").tobytes() for i, j in zip(new, ends)], pa.binary()),
                         "counts": pa.array([zipped(n[i:j]) for i, j in zip(new, ends)], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), "<u4") for c in group.column("keys").chunks for k in c]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unzipped(c) for c in group.column("counts").to_pylist()])).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        answers = [zipped(np.minimum(total[place[j - len(k):j]], 2**32 - 1)) for k, j in zip(keys, ends)]
        none = pa.nulls(len(keys), pa.int64())
        return pa.table({"chunk": group.column("chunk"), "slice": group.column("slice"), "doc_id": none, "d1": none, "counts": pa.array(answers, pa.binary())})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return PREFIX.empty_table()
        answers, wanted = {}, set()
        for part, doc, d1, counts in zip(*[right.column(c).to_pylist() for c in ("slice", "doc_id", "d1", "counts")]):
            if part < 0:
                wanted.add((doc, d1))
            else:
                answers[part] = counts
        ids, blobs, value, at = chosen_sets(left, wanted, size)
        _, place = np.unique(coded(value, slices), return_inverse=True)
        frequency = np.concatenate([np.zeros(0, np.uint32), *[unzipped(answers[k]) for k in sorted(answers)]]).astype(np.int64)[place]
        order = np.lexsort((value, frequency, vt.rows_of(at)))
        value, frequency = value[order].view(np.int64), frequency[order]
        n = np.diff(at)
        cost = np.concatenate([[0], np.cumsum(frequency - 1)]).astype(np.float64)
        matches = prefix_choice(n, at, cost, percent)
        own = vt.per_row(frequency == 1, at)
        least = -(-percent * n // 100)
        mine = np.flatnonzero(n - least + 1 > own)
        end = np.minimum(n - least + matches, n)
        tokens = [value[at[k] + own[k]:at[k] + end[k]] for k in mine]
        return pa.table({"node": pa.array(ids[mine]), "n": pa.array(n[mine]), "matches": pa.array(matches[mine]), "first": pa.array(own[mine] + 1),
                         "tokens": pa.array(tokens, pa.list_(pa.int64())), "packed": pa.array([blobs[k] for k in mine], pa.binary())})

    questions = rows.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(ask, "slice int, chunk int, keys binary, counts binary")
    answers = questions.repartition(slices, "slice").groupBy("slice").applyInArrow(count, "chunk int, slice int, doc_id long, d1 long, counts binary")
    return rows.groupBy("chunk").cogroup(answers.unionByName(reps).groupBy("chunk")).applyInArrow(choose, "node long, n long, matches long, first long, tokens array<long>, packed binary")


def matched(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share as many prefix tokens as the less demanding of them asks for."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("matches").alias(f"m{c}"), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    able = needed(F.col("na"), F.col("nb"), percent) <= F.least("na", "nb")
    return both.where(able & (F.size(F.array_intersect("ta", "tb")) >= F.least("ma", "mb"))).select("a", "b")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id (the smallest doc_id
    reachable through links of similarity ``percent`` or more, its own if there are none) and kept
    (whether it is that one). A null or wordless text has no shingles and is linked with nothing. A
    null doc_id gets a null component and is kept. Rows that share a doc_id are one node that holds
    several texts, linked when one of them is; each row reports its own n_shingles. Ties and repeated
    rows fall in one class; an empty table gives an empty result. Texts are whole, however long."""
    docs = docs.select("doc_id", "text")
    chunks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))
    signed = stored(signed_sets(docs, size, chunks), "signed-sets")
    full = signed.where("n > 0 and doc_id is not null")
    least = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "chunk")).alias("low"))
    classes = stored(least.select("d1", "d2", "n", F.col("low.doc_id").alias("node"), F.col("low.chunk").alias("chunk")), "classes")
    # a doc_id with several texts may stand for several classes: they are told apart by their rows here and joined by resolved()
    found = stored(prefixes(docs, classes, size, percent, chunks), "prefixes")
    places = found.select("node", "n", F.posexplode("tokens").alias("at", "token"), "first").withColumn("pos", F.col("at") + F.col("first"))
    first = places.where(F.col("pos") <= F.col("n") + F.floor(-percent * F.col("n") / F.lit(100)) + 1)
    postings = stored(useful(first.select("token", "node", "n", "pos"), percent), "postings")
    texts = found.select(F.col("node").alias("doc_id"), "packed")
    links = verified(matched(stars(postings), found, percent), texts, size, percent)
    more = matched(stored(pairs_across(postings, components(links), percent), "across"), found, percent)
    links = stored(links.union(verified(more, texts, size, percent)), "all-links")
    return resolved(signed, classes, links)
