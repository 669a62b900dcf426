"""Quality rules: counts of every whole text, base rules, and a trained judgement.

The judgement is a logistic regression over hashed words, word pairs and byte n-grams, fitted
on a bounded sample of labelled rows, calibrated on another part of that sample, and compared
with a fixed threshold. Texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harvestline.llm import vectext as vt
from harvestline.llm.common import pieces, prepared
from harvestline.llm.linear import ROWS, bounded_sample, features, fit_logistic, fit_platt, sample_features

U = np.uint64
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BITS, CHARS = 14, (2, 3, 4)
SAMPLE = 2400           # labelled rows used for fitting and calibration, at most
THRESHOLD = 0.5         # calibrated probability of good quality from which a text is kept
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; words are runs without ASCII white space."""
    start, end, word_off = vt.words(raw, off)
    in_word = ~vt.SPACE[raw]
    out = {
        "n_words": np.diff(word_off),
        "word_chars": vt.per_row(in_word & ((raw & 0xC0) != 0x80), off),
        "n_symbols": vt.per_row(SYMBOL[raw], off),
    }
    # lines: runs without \n; those that hold a word and equal an earlier one of their text
    line_start, line_end, line_off = vt.runs(raw != 10, off)
    has_word = vt.per_row(in_word, np.append(line_start, len(raw))) > 0 if len(line_start) else np.zeros(0, bool)
    key = vt.span_hashes(raw, line_start, line_end, 2)
    rows = vt.rows_of(line_off)
    keep = np.flatnonzero(has_word)
    unique = np.unique(vt.mix(key[keep]) + vt.mix(rows[keep].astype(np.uint64) + U(1)), return_index=True)[1]
    n = len(off) - 1
    out["n_dup_lines"] = np.bincount(rows[keep], minlength=n) - np.bincount(rows[keep][unique], minlength=n)
    # words covered by a 3-word window that its text holds twice or more
    h = vt.span_hashes(raw, start, end, 4)
    at, window_off = vt.window_rows(word_off, 3)
    covered = np.zeros(len(h) + 1, bool)
    if len(at):
        code = vt.windows(h, 3, 5)[at] + vt.mix(vt.rows_of(window_off).astype(np.uint64) + U(1))
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        repeated = at[count[inverse] > 1]
        for k in range(3):
            covered[repeated + k] = True
    out["n_repeat_words"] = vt.per_row(covered[:len(h)], word_off)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, text, y) of at most ``size`` labelled documents. The sample of ids has a proven
    bound, so it is broadcast to the documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("label_id"), F.col(label).cast("string").alias("y"))
    chosen = bounded_sample(known, ["label_id", "y"], size)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights of the judgement; every fourth sampled row calibrates. Without labels of both
    kinds the model says 1 for every text."""
    x, y = sample_features(labelled_sample(docs, labels, "quality", sample), BITS, CHARS, True, sparse=True)
    good = (y.astype(str) == "1").astype(np.float32)
    part = np.arange(len(good)) % 4 == 3
    if len(good) < 8 or good[~part].min() == good[~part].max():
        return {"w": np.zeros(1 << BITS, np.float32), "b": 0.0, "slope": 0.0, "intercept": 30.0}
    w, b = fit_logistic(x[~part], good[~part, None])
    slope, intercept = fit_platt(x[part] @ w[:, 0] + b[0], good[part])
    return {"w": w[:, 0], "b": float(b[0]), "slope": max(slope, 0.0), "intercept": intercept}


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ``base_failed``, the calibrated
    probability ``quality`` and ``kept``. Null and empty texts have zero counts and fail the base
    rules; a null doc_id stays null; repeated rows are judged each; an empty table gives none;
    labels of unknown documents and null labels are not used."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, raw, off in pieces(batches, rows=ROWS):
            counts = base_counts(raw, off)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            score = features(raw, off, BITS, CHARS, True) @ m["w"] + m["b"]
            quality = 1 / (1 + np.exp(-np.clip(m["slope"] * score + m["intercept"], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), *[pa.array(counts[k]) for k in COUNTS], pa.array(failed),
                 pa.array(~failed & (quality >= threshold)), pa.array(quality.astype(np.float64))],
                names=["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, quality double"
    return prepared(docs, "doc_id", "text").mapInArrow(run, schema)
