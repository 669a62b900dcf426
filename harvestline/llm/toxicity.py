"""Toxicity by nearest labelled examples.

Texts become TF-IDF vectors over all words of the examples; a term counts the more, the more its
presence goes with the label (chi-square over the number of examples), and none counts nothing.
Document frequencies are counted over the whole corpus. The k examples of largest cosine are found
exactly in a block-max inverted index: examples are arranged so that like ones share a block, the
largest weights of its terms bound a block's cosines, and blocks whose bound cannot reach the k-th
best are skipped with their postings. Votes weighted by cosine are calibrated on the examples, each
judged by the parts it is not in; the neighbours are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.llm import vectext as vt
from harvestline.llm.chunks import ragged
from harvestline.llm.common import pieces, prepared, remainder
from harvestline.llm.linear import fit_platt
from harvestline.llm.quality import labelled_sample

U = np.uint64
SAMPLE = 6000            # labelled rows used as examples, at most
PARTS = 5                # parts of the examples for calibration
UNTIED = 0.001           # weight of a term that says nothing about the label; one that decides it has 1 more
HEADS = 256              # most frequent terms by which like examples are put together
NEIGHBOURS, POWER = 25, 1.0
BLOCK = 64               # examples in a block of the index
DENSE, SHARE = 384, 12   # terms whose postings are kept as a matrix, at most; each is in more than a SHARE-th of the examples
TEXTS = 128              # texts multiplied with that matrix at once
FIRST = 8                # blocks scored first; each further group is eight times as large
SLICE = 1 << 14          # terms whose document frequencies are added up together
FOLD, HELD_OUT = 5, 0    # crc32 of the id modulo FOLD is HELD_OUT: never learned from
# token bytes: ASCII letters and digits, and every byte beyond ASCII
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all term occurrences: lower-cased tokens."""
    start, end, token_off = vt.runs(TOKEN[raw], off)
    return vt.span_hashes(vt.LOWER[raw], start, end, 6), vt.rows_of(token_off)


def term_counts(raw: np.ndarray, off: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) sorted by text and term; term is the place in the sorted vocabulary
    if one is given (others are left out), else the hash."""
    h, row = terms(raw, off)
    if vocabulary is not None and len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        key = np.sort(row[known].astype(np.int64) * len(vocabulary) + at[known])
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[new] // len(vocabulary), (key[new] % len(vocabulary)).astype(np.uint64), np.diff(np.append(new, len(key)))
    if vocabulary is not None:
        h, row = h[:0], row[:0]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return row[new], h[new], np.diff(np.append(new, len(h)))


class BlockMaxIndex:
    """Inverted index of sparse unit vectors (rows, terms, weights), in blocks of rows. Postings of
    the most frequent terms stand in a matrix, so that many texts are multiplied with it at once."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int):
        self.block_count = max(1, -(-n_rows // BLOCK))
        seen = np.bincount(term, minlength=n_terms)
        heads = np.argsort(-seen, kind="stable")[:DENSE]
        heads = heads[seen[heads] * SHARE > n_rows]
        self.heads = len(heads)
        self.place = np.full(n_terms, -1, np.int32)
        self.place[heads] = np.arange(len(heads))
        head = self.place[term] >= 0
        self.head = self.place[term[head]], row[head].astype(np.int32), weight[head]
        self.matrix = None  # filled where it is needed, not shipped
        row, term, weight = row[~head], term[~head], weight[~head]
        order = np.lexsort((row, term))
        self.row, self.weight = row[order].astype(np.int64), weight[order]
        # one entry for each term and block that has postings: first posting and largest weight
        key = term[order].astype(np.int64) * self.block_count + self.row // BLOCK
        self.first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.entry_block = key[self.first] % self.block_count if len(key) else self.first
        self.entry_max = np.maximum.reduceat(self.weight, self.first) if len(key) else np.zeros(0)
        self.term_entry = np.searchsorted(key[self.first] // self.block_count if len(key) else self.first, np.arange(n_terms + 1))
        self.first = np.append(self.first, len(self.row))
        self.scored = self.held = 0  # postings outside the matrix that searches have scored, and that their terms have

    def __getstate__(self) -> dict:
        return {**self.__dict__, "matrix": None}

    def head_scores(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """What the most frequent terms add to the cosine of each of n texts with each row."""
        if self.matrix is None:
            place, row, value = self.head
            self.matrix = np.zeros((self.heads, self.block_count * BLOCK))
            self.matrix[place, row] = value
        place = self.place[term]
        mine, texts = place >= 0, np.zeros((n, len(self.matrix)))
        texts[text[mine], place[mine]] = weight[mine]
        return texts @ self.matrix

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines (nine digits) of the k best with a positive cosine. Blocks are scored
        by falling bound, a growing group at a time, until no bound exceeds the k-th best; of rows
        that tie at the k-th place those of blocks scored earlier stay, then smaller rows."""
        return next(self.nearest_each(np.zeros(len(term), np.int64), term, weight, 1, k))

    def nearest_each(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of n texts, whose terms are given in their order."""
        tail = self.place[term] < 0
        span, tail_span = np.searchsorted(text, np.arange(n + 1)), np.searchsorted(text[tail], np.arange(n + 1))
        tail_term, tail_weight = term[tail], weight[tail]
        for at in range(0, n, TEXTS):
            end = min(at + TEXTS, n)
            mine = slice(span[at], span[end])
            heads = self.head_scores(text[mine] - at, term[mine], weight[mine], end - at)
            bounds = heads.reshape(len(heads), -1, BLOCK).max(2)
            for i, j, head, bound in zip(tail_span[at:end], tail_span[at + 1:end + 1], heads, bounds):
                yield self._search(head, bound, tail_term[i:j], tail_weight[i:j], k)

    def _search(self, head: np.ndarray, bound: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest``, given the scores by the matrix, their largest in each block, and the other terms."""
        start = self.term_entry[term]
        n = self.term_entry[term + 1] - start
        entry, share = ragged(start, n), np.repeat(weight, n)
        block = self.entry_block[entry]
        bound = np.round(bound + np.bincount(block, self.entry_max[entry] * share, minlength=self.block_count) + 1e-12, 9)
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[:int((bound > 0).sum())]
        best_row, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST
        while at < len(by_bound):
            if len(best) == k:
                by_bound = by_bound[:max(at, int(np.searchsorted(-bound[by_bound], -best[-1])))]
                if at >= len(by_bound):
                    break
            chosen = np.zeros(self.block_count, bool)
            chosen[by_bound[at:at + step]] = True
            if 2 * len(by_bound[at:at + step]) > self.block_count:  # runs of whole terms are read faster
                first = self.first[start]
                n = self.first[self.term_entry[term + 1]] - first
                post, of = ragged(first, n), weight
            else:
                mine = np.flatnonzero(chosen[block])
                first = self.first[entry[mine]]
                n = self.first[entry[mine] + 1] - first
                post, of = ragged(first, n), share[mine]
            self.scored += len(post)
            score = head + np.bincount(self.row[post], self.weight[post] * np.repeat(of, n), minlength=len(head))
            score = np.round(score.reshape(-1, BLOCK)[chosen].ravel(), 9)
            hit = np.flatnonzero(score > (best[-1] if len(best) == k else 0.0))
            found = np.flatnonzero(chosen)[hit // BLOCK] * BLOCK + hit % BLOCK
            row, cosine = np.concatenate([best_row, found]), np.concatenate([best, score[hit]])
            if len(row) > 8 * k:  # all that tie with the k-th best stay for the sort
                near = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k])
                row, cosine = row[near], cosine[near]
            order = np.argsort(-cosine, kind="stable")[:k]
            best_row, best = row[order], cosine[order]
            at, step = at + step, step * 8
        self.held += int((self.first[self.term_entry[term + 1]] - self.first[start]).sum())
        return best_row, best


def arranged(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int) -> np.ndarray:
    """An order of the rows in which like ones are neighbours: parts are split at the median of their
    main direction over the most frequent terms until they fit a block."""
    seen = np.bincount(term, minlength=n_terms)
    heads = np.argsort(-seen, kind="stable")[:HEADS]
    place = np.full(n_terms, -1)
    place[heads] = np.arange(len(heads))
    x, mine = np.zeros((n_rows, len(heads))), place[term] >= 0
    x[row[mine], place[term[mine]]] = weight[mine]
    out, todo = [], [np.arange(n_rows)]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        centred = x[part] - x[part].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        sign = np.sign(direction[np.argmax(np.abs(direction))])
        part = part[np.argsort(centred @ direction * sign, kind="stable")]
        half = -(-len(part) // (2 * BLOCK)) * BLOCK  # full blocks on the left
        todo += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def association(row: np.ndarray, term: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """How far the presence of each term goes with the label, from 0 to 1: chi-square of the
    2 x 2 table over the number of examples."""
    n1, n = float(y.sum()), float(len(y))
    a = np.bincount(term, y[row], minlength=n_terms)
    b = np.bincount(term, minlength=n_terms) - a
    c, d = n1 - a, n - n1 - b
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num((a * d - b * c) ** 2 / ((a + b) * (c + d) * n1 * (n - n1)))


def vectors(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n_rows: int) -> np.ndarray:
    """TF-IDF weights scaled to unit length per row."""
    weight = (1 + np.log(count)) * idf[term]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=n_rows))
    return weight / np.maximum(length[row], 1e-12)


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts of the whole corpus each term of the bounded vocabulary occurs. Tasks
    send their counts as arrays over slices of the vocabulary, the last entry being their number
    of texts; the arrays of a slice are added up."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value) + 1, np.int64)
        for rows, raw, off in pieces(batches):
            df[-1] += rows.num_rows
            df += np.bincount(term_counts(raw, off, shared.value)[1].astype(np.int64), minlength=len(df))
        blobs = [df[at:at + SLICE].astype("<i8").tobytes() for at in range(0, len(df), SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "n"])

    def total(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = None, None
        for batch in group:
            for blob in batch.column(1):
                mine = np.frombuffer(blob.as_py(), "<i8")
                part, n = batch.column(0)[0], mine if n is None else n + mine
        yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["part", "n"])

    sent = prepared(docs, "text").mapInArrow(run, "part int, n binary")
    found = {r["part"]: r["n"] for r in sent.groupBy("part").applyInArrow(total, "part int, n binary").toLocalIterator()}
    df = np.frombuffer(b"".join(found[k] for k in sorted(found)), "<i8")
    return (df[:-1], int(df[-1])) if len(df) else (np.zeros(len(vocabulary), np.int64), 0)


def vote(row: np.ndarray, cosine: np.ndarray, y: np.ndarray) -> float:
    """Share of the label among the neighbours, weighted by cosine ** POWER; -1 without any."""
    w = cosine ** POWER
    return float((w * y[row]).sum() / w.sum()) if len(row) else -1.0


def cross_votes(spark: SparkSession, row: np.ndarray, term: np.ndarray, count: np.ndarray, y: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vote on each example by the examples of the other parts; a task for each part."""
    shared = spark.sparkContext.broadcast((row, term, count, y, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, term, count, y, idf = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                other = np.arange(len(y)) % PARTS != k
                mine, asked = other[row], int((~other).sum())
                weights, index = indexed(np.cumsum(other)[row[mine]] - 1, term[mine], count[mine], y[other], idf)
                known = ~mine & (weights[term] > 0)
                left, t = np.cumsum(~other)[row[known]] - 1, term[known]
                found = index.nearest_each(left, t, vectors(left, t, count[known], weights, asked), asked, NEIGHBOURS)
                votes = np.array([vote(near, cosine, y[other]) for near, cosine in found], "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([votes.tobytes()], pa.binary())], names=["part", "votes"])

    votes = np.zeros(len(y))
    for r in spark.range(0, PARTS, 1, PARTS).mapInArrow(run, "part long, votes binary").collect():
        votes[r["part"]::PARTS] = np.frombuffer(r["votes"], "<f8")
    shared.destroy()
    return votes


def calibration(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept for votes. Where the examples that got one share a label, they say nothing
    about votes for the other; then all votes for a label and one example of each kind set its rate."""
    pos = int((y > 0).sum())
    neg = len(y) - pos
    if pos and neg:
        return fit_platt(votes, y)
    low, high = np.log(1 / (neg + 2)), np.log(pos + 2)
    return float(high - low), float(low)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Index of the examples and calibration; None if no labelled text may be learned from."""
    may_learn = labels.where(remainder("doc_id", FOLD) != HELD_OUT)
    found = labelled_sample(docs, may_learn, "toxic", sample).groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a repeated id counts once
    rows = prepared(found, "doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in pieces(batches):
            row, term, count = term_counts(raw, off)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2),
                pa.array([term[i:j].astype("<u8").tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                pa.array([count[i:j].astype("<u4").tobytes() for i, j in zip(at, at[1:])], pa.binary())],
                names=["doc_id", "y", "term", "n"])

    found = rows.mapInArrow(run, "doc_id long, y string, term binary, n binary").toPandas()
    if not len(found):
        return None
    found = found.sort_values(["doc_id", "y"], kind="stable").reset_index(drop=True)
    ids, y = found["doc_id"].to_numpy(), (found["y"] == "1").to_numpy().astype(float)
    term = [np.frombuffer(t, "<u8") for t in found["term"]]
    count = [np.frombuffer(t, "<u4") for t in found["n"]]
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(t) for t in term])
    term, count = np.concatenate(term), np.concatenate(count)
    del found
    vocabulary, at = np.unique(term, return_inverse=True)
    at = at.astype(np.int32)
    del term
    df, n_docs = document_frequency(docs, vocabulary)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    votes = cross_votes(docs.sparkSession, row, at, count, y, idf)
    # a text without neighbours gets the base rate of such rows, drawn to that of all rows
    near = votes >= 0
    slope, intercept = calibration(votes[near], y[near])
    lone, base = y[~near], (y.sum() + 1) / (len(y) + 2)
    weights, index = indexed(row, at, count, y, idf)
    order = arranged(row, at, vectors(row, at, count, weights, len(y)), len(y), len(vocabulary))
    weights, index = indexed(np.argsort(order)[row], at, count, y[order], idf)
    return {"vocabulary": vocabulary, "idf": weights, "index": index, "y": y[order], "ids": ids[order],
            "slope": max(slope, 0.0), "intercept": intercept, "lone": float((lone.sum() + base) / (len(lone) + 1))}


def indexed(row: np.ndarray, term: np.ndarray, count: np.ndarray, y: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, BlockMaxIndex]:
    """Weights of all terms, 0 for those that no row has, and the index of the rows."""
    seen = np.bincount(term, minlength=len(idf)) > 0
    weights = np.where(seen, idf * (UNTIED + association(row, term, y, len(idf))), 0.0)
    return weights, BlockMaxIndex(row, term, vectors(row, term, count, weights, len(y)), len(y), len(idf))


def text_scores(m: dict | None, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Scores of texts, and ids and cosines of their three nearest examples."""
    n = len(off) - 1
    scores, ids, cosines = np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
    if m is not None:
        scores[:] = m["lone"]
        row, term, count = term_counts(raw, off, m["vocabulary"])
        term = term.astype(np.int64)
        weight = vectors(row, term, count, m["idf"], n)
        for k, (near, cosine) in enumerate(m["index"].nearest_each(row, term, weight, n, NEIGHBOURS)):
            share = vote(near, cosine, m["y"])
            if share >= 0:
                scores[k] = 1 / (1 + np.exp(-np.clip(m["slope"] * share + m["intercept"], -30, 30)))
                ids[k], cosines[k] = m["ids"][near[:3]].tolist(), np.minimum(cosine[:3], 1.0).tolist()
    return scores, ids, cosines


def not_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose own text is not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, raw, off in pieces(batches):
            yield rows.filter(pa.array(text_scores(m, raw, off)[0] < threshold))

    return prepared(docs, *docs.columns).mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, score, predicted, and the three
    nearest examples with their cosines as evidence. A null, empty or unrelated text has no
    neighbours and gets the base rate of such texts; without any usable label every score is
    the neutral 0. A null doc_id is never learned from and not held out; repeated rows are scored
    each; labels of unknown documents are not used."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, raw, off in pieces(batches):
            scores, ids, cosines = text_scores(m, raw, off)
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), rows.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "near_ids", "near_cosines"])

    held = prepared(docs, "doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", FOLD) == HELD_OUT, F.lit(False)))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, near_ids array<long>, near_cosines array<double>")
