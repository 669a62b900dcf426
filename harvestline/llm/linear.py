"""Hashed n-gram features of texts, and logistic regressions fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harvestline.llm import vectext as vt
from harvestline.llm.common import pieces, prepared

U = np.uint64


def char_grams(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` bytes within a text, and the text of each."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = (code << U(8)) | raw[k:k + n].astype(np.uint64)
    row = vt.rows_of(off)
    same = row[:n] == row[size - 1:]
    return (code[same] * U(0x9E3779B97F4A7C15)) ^ U(size * 0x51ED27), row[:n][same]


def buckets(raw: np.ndarray, off: np.ndarray, bits: int, chars: tuple[int, ...], with_words: bool) -> np.ndarray:
    """Rows x 2**bits counts of hashed byte n-grams and, if asked, words and word pairs."""
    rows, width = len(off) - 1, 1 << bits
    counts = np.zeros(rows * width, np.float32)
    shift = U(64 - bits)

    def add(h: np.ndarray, row: np.ndarray) -> None:
        flat = (h * U(0xD6E8FEB86659FD93) >> shift).astype(np.int64) + row * width
        counts[:] += np.bincount(flat, minlength=rows * width).astype(np.float32)

    for size in chars:
        add(*char_grams(raw, off, size))
    if with_words:
        start, end, word_off = vt.words(raw, off)
        h = vt.span_hashes(vt.LOWER[raw], start, end, 1)
        add(h, vt.rows_of(word_off))
        pair, pair_off = vt.window_rows(word_off, 2)
        if len(pair):
            add(vt.mix(h[pair] * U(3) + h[pair + 1]), vt.rows_of(pair_off))
    return counts.reshape(rows, width)


def features(raw: np.ndarray, off: np.ndarray, bits: int, chars: tuple[int, ...], with_words: bool) -> np.ndarray:
    """Square roots of the counts, each row scaled to length 1 (an empty text is all zero)."""
    x = np.sqrt(buckets(raw, off, bits, chars, with_words))
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(length, 1e-9)


ROWS = 64  # texts whose dense rows are held at once


def bounded_sample(labelled: DataFrame, keys: list[str], size: int) -> DataFrame:
    """At most ``size`` rows, the lowest by a hash of ``keys``: the same rows in every run."""
    order = F.xxhash64(F.lit(11), *[F.col(k) for k in keys])
    return labelled.orderBy(order, *keys).limit(size)


class SparseRows:
    """A matrix of few non-zero values (CSR), for products with few columns."""

    def __init__(self, at: np.ndarray, value: np.ndarray, length: np.ndarray, width: int):
        self.at, self.value, self.length, self.width = at, value, length, width
        self.row = np.repeat(np.arange(len(length), dtype=np.int32), length)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.length), self.width

    def __getitem__(self, chosen: np.ndarray) -> SparseRows:
        """The rows of a mask."""
        mine = chosen[self.row]
        return SparseRows(self.at[mine], self.value[mine], self.length[chosen], self.width)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        if w.ndim > 1:
            return np.stack([self @ c for c in w.T], 1)
        return np.bincount(self.row, self.value * w[self.at], minlength=len(self.length))

    def back(self, error: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``error``."""
        return np.stack([np.bincount(self.at, self.value * e[self.row], minlength=self.width) for e in error.T], 1)


def sample_features(texts: DataFrame, bits: int, chars: tuple[int, ...], with_words: bool,
                    sparse: bool = False) -> tuple[np.ndarray | SparseRows, np.ndarray]:
    """Features and labels of a bounded sample (doc_id, text, y): extracted by Spark tasks as
    sparse rows, gathered here. Rows come in the order of their ids; ``sparse`` keeps them so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, off in pieces(batches, rows=ROWS):
            x = features(raw, off, bits, chars, with_words)
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(2),
                pa.array([i.astype("<u4").tobytes() for i in at], pa.binary()),
                pa.array([r[i].astype("<f4").tobytes() for r, i in zip(x, at)], pa.binary())],
                names=["doc_id", "y", "at", "value"])

    found = prepared(texts, "doc_id", "text", "y").mapInArrow(run, "doc_id long, y string, at binary, value binary").toPandas()
    found = found.sort_values(["doc_id", "y"], kind="stable")
    if sparse:
        at = np.frombuffer(b"".join(found["at"]), "<u4").astype(np.int32)
        length = np.array([len(a) // 4 for a in found["at"]], np.int64)
        return SparseRows(at, np.frombuffer(b"".join(found["value"]), "<f4"), length, 1 << bits), found["y"].to_numpy()
    x = np.zeros((len(found), 1 << bits), np.float32)
    for k, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[k, np.frombuffer(at, "<u4")] = np.frombuffer(value, "<f4")
    return x, found["y"].to_numpy()


def fit_logistic(x: np.ndarray | SparseRows, y: np.ndarray, penalty: float = 1e-5, rounds: int = 300, rate: float = 60.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and intercepts of one logistic regression per column of
    ``y`` (0 or 1, both balanced by weight), by accelerated gradient steps from zero."""
    n, outputs = y.shape
    w = np.zeros((x.shape[1], outputs), np.float32)
    b = np.zeros(outputs, np.float32)
    last_w, last_b = w.copy(), b.copy()
    positive = np.clip(y.mean(0), 1e-6, 1 - 1e-6)
    weight = (np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive)) / n).astype(np.float32)
    for k in range(rounds):
        momentum = k / (k + 3)
        aw, ab = w + momentum * (w - last_w), b + momentum * (b - last_b)
        error = (1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30))) - y) * weight
        last_w, last_b = w, b
        slope = x.back(error) if isinstance(x, SparseRows) else x.T @ error
        w = (aw - rate * (slope + penalty * aw)).astype(np.float32)
        b = (ab - 4.0 * error.sum(0)).astype(np.float32)
    return w, b


def fit_platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn a score into a probability: Newton steps on the log loss
    with smoothed targets. One class only gives slope 0 and the smoothed base rate."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    if not pos or not neg:
        p = (pos + 1) / (pos + neg + 2)
        return 0.0, float(np.log(p / (1 - p)))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    design = np.stack([score, np.ones_like(score)], 1).astype(np.float64)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ [a, b], -30, 30)))
        grad = design.T @ (p - target)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
