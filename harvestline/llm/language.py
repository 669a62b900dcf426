"""Language identification by error-correcting output codes.

Every language has a codeword; one binary logistic regression over hashed byte n-grams predicts
each bit. A text gets the language whose codeword has the smallest loss, where each bit counts
by how well its classifier does on that language. The gap to the second best codeword tells
whether the answer is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import pieces, prepared, remainder
from harvestline.llm.linear import ROWS, bounded_sample, features, fit_logistic, sample_features

BITS, CHARS = 13, (1, 2, 3, 4)
SAMPLE = 2400          # labelled rows used for fitting, at most
FOLD, HELD_OUT = 4, 2  # crc32 of the id modulo FOLD is HELD_OUT: never learned from
AMBIGUOUS = 0.2        # smallest gap of probability between the best two languages
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1. Up to five languages: all distinct splits in two. More: the
    best of 64 random codes of 10 * log2(n) bits by the smallest distance between codewords."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 5:
        splits = [[1] + [1 if k >> (r - 1) & 1 else -1 for r in range(1, n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    width = int(np.ceil(10 * np.log2(n)))
    rng = np.random.Generator(np.random.PCG64(n))
    best, best_gap = None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        mixed = np.abs(code.sum(0, dtype=np.int64)) < n  # a bit on which all agree says nothing
        code[:, ~mixed] = np.where(np.arange(n)[:, None] % 2, 1, -1)
        same = code.astype(np.int64) @ code.T.astype(np.int64)
        gap = int(((width - same[~np.eye(n, dtype=bool)]) // 2).min())
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def decode(bits: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted loss of each codeword (rows x languages) for the margins of each bit."""
    loss = np.log1p(np.exp(-np.clip(bits[:, None, :] * code[None], -30, 30)))
    return (loss * weight[None]).sum(2)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Learns from rows with text, lang and doc_id outside the held-out part; None if there are
    none. Every fourth sampled row weighs the bits of its language."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLD) != HELD_OUT))
    ids = bounded_sample(learn.select("doc_id", F.col("lang").alias("y")), ["doc_id", "y"], sample)
    ids = ids.select(F.col("doc_id").alias("label_id"), "y")
    chosen = docs.join(F.broadcast(ids), (F.col("doc_id") == F.col("label_id")) & (F.col("lang") == F.col("y")))
    x, y = sample_features(chosen.select("doc_id", "text", "y"), BITS, CHARS, False)
    if not len(y):
        return None
    names, label = np.unique(y.astype(str), return_inverse=True)
    code = codewords(len(names))
    part = np.arange(len(y)) % 4 == 3
    part &= np.isin(label, label[~part])
    w, b = fit_logistic(x[~part], (code[label[~part]] > 0).astype(np.float32))
    right = ((x[part] @ w + b) * code[label[part]]) > 0
    weight = np.empty(code.shape)
    for r in range(len(names)):  # share of right bits per language, smoothed; each language's weights add up to 1
        mine = right[label[part] == r]
        weight[r] = (mine.sum(0) + 1) / (len(mine) + 2)
    return {"names": names.tolist(), "code": code, "w": w, "b": b, "weight": weight / weight.sum(1, keepdims=True)}


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    total = np.concatenate([[0], np.cumsum(LETTER[raw])])
    found = total[off[1:]] > total[off[:-1]]
    for k in np.flatnonzero(~found):
        text = raw[off[k]:off[k + 1]]
        found[k] = bool((text >= 0x80).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, sample: int = SAMPLE, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): held_out, lang_pred, score (probability
    of that language), ``ambiguous`` and the runner-up. A null text and one without a letter are
    ``und`` with score 0, as is everything if no row can be learned from. A null doc_id is never
    learned from and counts as not held out; repeated rows are judged each."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, raw, off in pieces(batches, rows=ROWS):
            n = len(off) - 1
            letters = has_letter(raw, off)
            pred, second, score, gap = np.full(n, "und", object), np.full(n, None, object), np.zeros(n), np.zeros(n)
            if m is not None:
                loss = decode(features(raw, off, BITS, CHARS, False) @ m["w"] + m["b"], m["code"], m["weight"])
                p = np.exp(-len(m["code"][0]) * (loss - loss.min(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                order = np.argsort(-p, 1, kind="stable")
                names = np.array(m["names"], object)
                at = np.arange(n)
                best = p[at, order[:, 0]]
                pred = np.where(letters, names[order[:, 0]], "und")
                score = np.where(letters, best, 0.0)
                if len(names) > 1:
                    second = np.where(letters, names[order[:, 1]], None)
                    gap = best - p[at, order[:, 1]]
                else:
                    gap = best
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), rows.column(2), pa.array(pred.tolist(), pa.string()), pa.array(score),
                pa.array(letters & (gap < ambiguous)), pa.array(second.tolist(), pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous", "lang_second"])

    held = prepared(docs, "doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", FOLD) == HELD_OUT, F.lit(False)))
    return held.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, lang_second string")
