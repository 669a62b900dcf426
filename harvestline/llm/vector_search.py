"""Exact top-k by inner product with multi-resolution segment statistics.

Components become whole 1024ths; a vector's summary at a resolution of s segments holds the mean and
the deviation of each segment. By Cauchy-Schwarz on what the means leave over, the inner product
of two summaries bounds the inner product of the vectors from above, which is a lower bound of
their distance. Bounds run from coarse to fine against the k-th best score found so far; only
the pairs that survive are scored exactly: in doubles where no sum can pass 2**53, else in integers
of 64 bits or of any length.

Queries are taken in blocks of bounded size. A block is broadcast, every candidate partition
keeps its own k best of each query, and these few rows are merged by query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from harvestline.llm.common import prepared, scratch_path

SCALE = 1024
DOUBLE, LONG = 2.0 ** 52, 2.0 ** 61  # products of lengths up to which sums are exact in doubles, in 64 bits
MARGIN = 1e-6          # error of bounds, relative to the product of the lengths
LOW, HIGH = -(1 << 63), (1 << 63) - 1
WIDTH = 272            # bytes of the largest possible score: two doubles, 20 bits of scale, a sum
SEGMENTS = (1, 4, 16)  # resolutions, coarse to fine
QUERY_BLOCK = 1024     # queries broadcast at once: at most 1024 x dimension x 8 bytes
ROWS = 1024            # candidates compared at once
PAIRS = 1 << 15        # pairs scored at once
DENSE = 0.2            # share of surviving pairs from which a whole matrix is cheaper than pairs


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components cut to whole 1024ths, the offsets of each vector, and which vectors take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.where(np.abs(x) < 2.0 ** 53, np.floor(SCALE * x) / SCALE, x)
    bad = null | ~np.isfinite(x)
    off = np.concatenate([[0], np.cumsum(lengths)])
    wrong = np.concatenate([[0], np.cumsum(bad)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[off[1:]] == wrong[off[:-1]])
    return np.where(bad, 0.0, whole), off, usable


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the usable vectors of each dimension in a batch (vec_id, embedding)."""
    flat, off, usable = integers(batch.column(1))
    ids = batch.column(0)
    usable &= ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for dim in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == dim))
        yield ids[rows], flat[(off[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """For each resolution, means and deviations of all segments, scaled by the root of the
    segment's length, so that summaries multiply to a bound. The vector itself comes last."""
    x = x.astype(np.float64)
    out = []
    for s in SEGMENTS:
        if s >= x.shape[1]:
            continue
        starts = np.linspace(0, x.shape[1], s + 1).astype(np.int64)
        length = np.diff(starts)
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.add.reduceat(x, starts[:-1], axis=1)
            square = np.add.reduceat(x * x, starts[:-1], axis=1)
            out.append(np.concatenate([total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0))], axis=1))
    return [*out, x]


def near_float(score: int) -> float:
    try:
        return score / SCALE ** 2
    except OverflowError:
        return sys.float_info.max if score > 0 else -sys.float_info.max


def whole_numbers(x: np.ndarray) -> list[int]:
    """The components times SCALE, as integers of any length."""
    return [int(v) * SCALE if abs(v) >= 2.0 ** 53 else int(v * SCALE) for v in x.tolist()]


def exact_scores(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Inner products of the rows in units of SCALE ** -2; ``reach`` is the product of their
    lengths. 64-bit integers, or Python's if one could be too long for them."""
    score = np.zeros(len(q), np.int64)
    short, long = reach * SCALE ** 2 < DOUBLE, reach * SCALE ** 2 < LONG
    score[short] = np.rint(np.einsum("ij,ij->i", q[short], c[short]) * SCALE ** 2).astype(np.int64)
    some = np.flatnonzero(long & ~short)
    for at in range(0, len(some), ROWS):
        k = some[at:at + ROWS]
        score[k] = np.einsum("ij,ij->i", (q[k] * SCALE).astype(np.int64), (c[k] * SCALE).astype(np.int64))
    if not long.all():
        score = score.astype(object)
        for k in np.flatnonzero(~long):
            score[k] = sum(a * b for a, b in zip(whole_numbers(q[k]), whole_numbers(c[k])))
    return score


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.row = k, np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place < self.k]
        self.row, self.score, self.id = row[place < self.k], score[keep], ids[keep]
        last = place[place < self.k] == self.k - 1
        self.floor[self.row[last]] = [near_float(v) for v in self.score[last].tolist()]

    def columns(self) -> list[pa.Array]:
        """Scores held to 64 bits, and for those at an end a key that orders them further."""
        score = [min(max(v, LOW), HIGH) for v in self.score.tolist()]
        beyond = [(v + (1 << 8 * WIDTH - 1)).to_bytes(WIDTH, "big") if v <= LOW or v >= HIGH else b"" for v in self.score.tolist()]
        return [pa.array(score, pa.int64()), pa.array(beyond, pa.binary())]


def compare(best: Best, ids: np.ndarray, summary: list[np.ndarray], query_ids: np.ndarray, query_summary: list[np.ndarray]) -> None:
    """Adds one chunk of candidates: bounds coarse to fine, exact scores for the survivors. What
    doubles cannot hold bounds nothing."""
    alive = query_ids[:, None] != ids[None, :]
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    with np.errstate(over="ignore", invalid="ignore"):
        length_q, length_c = (np.sqrt((x[-1] * x[-1]).sum(1)) for x in (query_summary, summary))
        reach = length_q[:, None] * length_c[None, :]
        least = best.floor[:, None] - np.where(np.isfinite(reach), MARGIN * reach, np.inf)
        for q, c in zip(query_summary, summary):
            if pairs is None:
                bound = q @ c.T
                alive &= ~np.isfinite(bound) | (bound >= least)
                if c is summary[-1] or alive.mean() < DENSE:
                    pairs = np.nonzero(alive)
            else:
                bound = np.einsum("ij,ij->i", q[pairs[0]], c[pairs[1]])
                keep = ~np.isfinite(bound) | (bound >= least[pairs])
                pairs = pairs[0][keep], pairs[1][keep]
        reach = np.where(np.isfinite(reach[pairs]), reach[pairs], np.inf)
    for at in range(0, len(pairs[0]), PAIRS):
        row, column = pairs[0][at:at + PAIRS], pairs[1][at:at + PAIRS]
        best.add(row, exact_scores(query_summary[-1][row], summary[-1][column], reach[at:at + PAIRS]), ids[column])


def packed_queries(vectors: DataFrame, every: int) -> DataFrame:
    """The query rows packed into blocks: (dim, ids, components as bytes)."""
    chosen = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-chosen.count() // QUERY_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in by_dimension(batch):
                for at in range(0, len(ids), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.shape[1]], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([x[part].astype("<f8").tobytes()])],
                        names=["dim", "ids", "x"])

    return chosen.repartition(blocks).mapInArrow(run, "dim int, ids binary, x binary")


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is
    divisible by ``every``; fewer rows have fewer. Only vectors of the query's dimension are
    candidates, and no row with the query's own vec_id. Vectors that are null, hold a null,
    or a non-finite component, or have a null id take no part; a vector of dimension 0 scores 0.
    Scores beyond 64 bits are ranked exactly and shown as the last 64-bit number. Repeated candidates are ranked each, equal ones in turn; repeated query rows are
    answered each. Without queries the result is empty."""
    spark = embeddings.sparkSession
    vectors = prepared(embeddings, "vec_id", "embedding")
    path, schema = scratch_path(spark, "nearest"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in packed_queries(vectors, every).toLocalIterator():
        query_ids = np.frombuffer(block["ids"], "<i8")
        queries = np.frombuffer(block["x"], "<f8").reshape(len(query_ids), block["dim"])
        shared = spark.sparkContext.broadcast((query_ids, queries))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries = shared.value
            query_summary, best = summaries(queries), Best(len(query_ids), k)
            for batch in batches:
                for ids, x in by_dimension(batch):
                    for at in range(0, len(ids) if x.shape[1] == queries.shape[1] else 0, ROWS):
                        compare(best, ids[at:at + ROWS], summaries(x[at:at + ROWS]), query_ids, query_summary)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.row), pa.array(query_ids[best.row]), pa.array(best.id), *best.columns()], names=["query", "query_id", "vec_id", "score", "beyond"])

        found = vectors.mapInArrow(run, "query long, query_id long, vec_id long, score long, beyond binary")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)
