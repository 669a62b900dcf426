"""Hard negatives by Fagin's threshold algorithm.

Candidates are dealt to groups and sorted, block by block, by every dimension. For an anchor the
lists are read from the end that its component's sign favours, some entries of all lists at a time;
rows that turn up are scored by random access in whole numbers. What the lists show at the depth
read so far bounds the score of every row not seen: the anchor is done with a block once that
threshold is strictly below the k-th score of each of its windows. The best rows of a group's
earlier blocks count for its later ones. Anchors read the lists together, from both ends, and rows
that turn up for one are scored for all that are not done; vectors too long for exact sums in
doubles are searched one anchor at a time, in integers of any length.

A first search finds each anchor's positives, a second the negatives of the window that each
positive opens. In both, anchors and candidates meet as blocks of a grid, one job for all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from harvestline.llm.common import prepared, stored
from harvestline.llm.vector_search import HIGH, LOW, WIDTH

SCALE = 256
GROUP, ANCHORS = 2048, 4096  # candidates and anchors of one cell of the grid, about
BLOCK = 2048                 # candidates whose lists are sorted at once
TAME = 2.0 ** 25             # length times SCALE up to which scores, times BLOCK, fit 62 bits
NONE = -(1 << 62)            # below any such score times BLOCK
DEPTH = 8                    # entries read first from each list; each further read doubles the depth
EXACT = 2.0 ** 52            # products of lengths up to which sums are exact in doubles
EMPTY = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])
MARGIN = 1e-9                # error of longer sums, relative to the product of the lengths


def vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, with a key of their own."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = prepared(embeddings, "vec_id", "embedding", "label").where("vec_id is not null and embedding is not null and label is not null").where(usable)
    return stored(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"),
                              F.monotonically_increasing_id().alias("row")), "vectors")


def whole(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors with components cut to whole multiples of 1 / SCALE."""
    out = []
    for v in column.combine_chunks():
        x = np.asarray(v.values, np.float64)
        with np.errstate(over="ignore"):
            out.append(np.where(np.abs(x) < 2.0 ** 44, np.floor(SCALE * x) / SCALE, x))
    return out


def integers(x: np.ndarray) -> list[int]:
    return [int(v) * SCALE if abs(v) >= 2.0 ** 44 else int(v * SCALE) for v in x.tolist()]


def scored(x: np.ndarray, length: np.ndarray, anchor: np.ndarray, anchor_length: float) -> np.ndarray:
    """Exact inner products in units of SCALE ** -2."""
    if not len(x) or length.max() * anchor_length * SCALE ** 2 < EXACT:
        return np.rint(x @ anchor * SCALE ** 2).astype(np.int64)
    a = integers(anchor)
    return np.array([sum(p * q for p, q in zip(a, integers(row))) for row in x], object)


class Interval:
    """The k best (score, id) so far with a score from low to high (None: open)."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.best = k, low, high, []

    def floor(self) -> int | float:
        """A row that is not seen matters only from this score on."""
        return self.best[-1][0] if len(self.best) == self.k else -math.inf if self.low is None else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        least = self.floor()
        fits = score >= least if least > -math.inf else np.ones(len(score), bool)
        if self.high is not None:
            fits = fits & (score <= self.high)
        if fits.any():
            self.best = sorted([*self.best, *zip(score[fits].tolist(), ids[fits].tolist())], key=lambda e: (-e[0], e[1]))[:self.k]


class SortedLists:
    """A block of candidates by rising id, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)  # dimension x place, rising
        self.length = lengths(x)

    def search(self, anchor: np.ndarray, length: float, may: np.ndarray, windows: list[Interval]) -> int:
        """Offers the windows every row of ``may`` that can matter; returns how many were scored."""
        n, lists = len(self.ids), np.flatnonzero(anchor)
        rising = anchor[lists] < 0
        reach = (self.length.max() if n else 0.0) * length * SCALE ** 2
        slack = 0.0 if reach < EXACT else MARGIN * reach
        unseen, depth, read, done = may.copy(), 0, DEPTH, 0
        while depth < n:
            last = min(depth + read, n) if len(lists) else n
            up, down = self.order[lists[rising], depth:last], self.order[lists[~rising], n - last:n - depth]
            rows = np.flatnonzero(unseen) if last == n else found(n, unseen, up, down)
            unseen[rows] = False
            done += len(rows)
            score = scored(self.x[rows], self.length[rows], anchor, length)
            for w in windows:
                w.offer(score, self.ids[rows])
            depth, read = last, depth + read
            if depth < n:
                at = self.order[lists, np.where(rising, depth - 1, n - depth)]
                with np.errstate(over="ignore", invalid="ignore"):
                    threshold = float(np.dot(anchor[lists], self.x[at, lists])) * SCALE ** 2 + slack
                if all(threshold < w.floor() for w in windows):
                    break
        return done

    def search_all(self, batch: Batch, same_label: bool) -> int:
        """The same for a batch of anchors; both of tame length. Returns how many pairs were scored."""
        n, dims = len(self.ids), np.arange(self.x.shape[1])
        unseen, active, depth, read, done = np.ones(n, bool), np.arange(len(batch.ids)), 0, DEPTH, 0
        while depth < n and len(active):
            last = min(depth + read, n) if len(dims) else n
            rows = np.flatnonzero(unseen) if last == n else found(n, unseen, self.order[:, depth:last], self.order[:, n - last:n - depth])
            unseen[rows] = False
            done += len(rows) * len(active)
            key = np.rint((batch.x[active] @ self.x[rows].T) * SCALE ** 2).astype(np.int64) * BLOCK + (BLOCK - 1 - rows)
            alike = batch.labels[active, None] == self.labels[rows]
            key[~(alike & (batch.ids[active, None] != self.ids[rows])) if same_label else alike] = NONE
            key.sort(axis=1)
            for w in range(batch.low.shape[1]):
                batch.offer(active, w, key, self.ids)
            depth, read = last, depth + read
            if depth < n:
                x = batch.x[active]
                threshold = (np.maximum(x, 0) @ self.x[self.order[:, n - depth], dims] + np.minimum(x, 0) @ self.x[self.order[:, depth - 1], dims]) * SCALE ** 2
                active = active[~(threshold[:, None] < batch.floor(active)).all(1)]
        return done


class Batch:
    """Anchors of tame length, with the k best (score, id) so far in windows from ``low`` to ``high``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list[list[Interval]]):
        self.ids, self.labels, self.x = ids, labels, x
        k, count = max(w.k for ws in windows for w in ws), max(len(ws) for ws in windows)
        bound = lambda v, default: default if v is None else min(max(v, -(1 << 51)), 1 << 51)  # noqa: E731  beyond any tame score
        closed = Interval(k, 1 << 51, -(1 << 51))
        full = [[*ws, *[closed] * (count - len(ws))] for ws in windows]
        self.low = np.array([[bound(w.low, -(1 << 51)) for w in ws] for ws in full], np.int64)
        self.high = np.array([[bound(w.high, 1 << 51) for w in ws] for ws in full], np.int64)
        self.score, self.id = np.full((len(ids), count, k), NONE), np.zeros((len(ids), count, k), np.int64)

    def floor(self, active: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[active, :, -1], self.low[active])

    def offer(self, active: np.ndarray, w: int, key: np.ndarray, ids: np.ndarray) -> None:
        """``key``: for each anchor, rising, scores of rows and the rows' places, or NONE."""
        k = self.score.shape[2]
        end = np.count_nonzero(key < ((self.high[active, w] + 1) * BLOCK)[:, None], axis=1)
        place = end[:, None] - 1 - np.arange(k)
        got = np.where(place >= 0, np.take_along_axis(key, np.maximum(place, 0), 1), NONE) if key.shape[1] else np.full((len(active), k), NONE)
        got[got < (self.low[active, w] * BLOCK)[:, None]] = NONE
        score = np.where(got > NONE, got >> BLOCK.bit_length() - 1, NONE)
        row = np.where(got > NONE, BLOCK - 1 - got % BLOCK, 0)
        score, new = np.concatenate([self.score[active, w], score], 1), np.concatenate([self.id[active, w], ids[row]], 1)
        order = np.lexsort((new, -score), axis=1)[:, :k]
        self.score[active, w], self.id[active, w] = np.take_along_axis(score, order, 1), np.take_along_axis(new, order, 1)


def lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def found(n: int, unseen: np.ndarray, *lists: np.ndarray) -> np.ndarray:
    """Rows that the lists show and that were not seen before."""
    hit = np.zeros(n, bool)
    for rows in lists:
        hit[rows.ravel()] = True
    return np.flatnonzero(hit & unseen)


def in_grid(candidates: DataFrame, anchors: DataFrame, windows: Callable[[dict], list[Interval]], same_label: bool) -> DataFrame:
    """row, place, vec_id, score, beyond: of each group of candidates the best rows for every window
    (place, from 0) of every anchor."""
    groups, blocks = (max(1, -(-df.count() // most)) for df, most in ((candidates, GROUP), (anchors, ANCHORS)))
    dealt = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = candidates.select("vec_id", "x", "label", dealt[0], every(blocks, "b"))
    # named anew, since both sides may come from one table
    right = anchors.select(*[F.col(c).alias(f"anchor_{c}") for c in anchors.columns], dealt[1], every(groups, "g"))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return EMPTY.empty_table()
        asked = asked.rename_columns([c.removeprefix("anchor_") for c in asked.column_names])
        x, own, anchor_x = whole(rows.column("x")), asked.to_pylist(), whole(asked.column("x"))
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        open_, out = [windows(a) for a in own], []
        for dim in sorted({len(a) for a in anchor_x}):
            mine = np.array([i for i, v in enumerate(x) if len(v) == dim], np.int64)
            mine = mine[np.lexsort((labels[mine], ids[mine]))]
            asking = np.array([i for i, v in enumerate(anchor_x) if len(v) == dim], np.int64)
            rows_x, asking_x = np.array([x[i] for i in mine]).reshape(len(mine), dim), np.array([anchor_x[i] for i in asking]).reshape(len(asking), dim)
            tame, calm = lengths(rows_x) * SCALE < TAME, lengths(asking_x) * SCALE < TAME
            batch = Batch(np.array([own[i]["vec_id"] for i in asking[calm]], np.int64), np.array([own[i]["label"] for i in asking[calm]], np.int64),
                          asking_x[calm], [open_[i] for i in asking[calm]]) if calm.any() else None
            for part, short in ((np.flatnonzero(tame), True), (np.flatnonzero(~tame), False)):
                for at in range(0, len(part), BLOCK):
                    k = part[at:at + BLOCK]
                    block = SortedLists(ids[mine[k]], labels[mine[k]], rows_x[k])
                    if short and batch:
                        block.search_all(batch, same_label)
                    for i in asking[~calm] if short else asking:
                        a = own[i]
                        may = (block.labels == a["label"]) & (block.ids != a["vec_id"]) if same_label else block.labels != a["label"]
                        block.search(anchor_x[i], float(lengths(anchor_x[i][None])[0]), may, open_[i])
            if batch:
                for i, w, p in zip(*np.nonzero(batch.score > NONE)):
                    out.append((own[asking[calm][i]]["row"], int(w), int(batch.id[i, w, p]), int(batch.score[i, w, p])))
        out += [(a["row"], p, i, s) for a, ws in zip(own, open_) for p, w in enumerate(ws) for s, i in w.best]
        score = [min(max(r[3], LOW), HIGH) for r in out]
        beyond = [(r[3] + (1 << 8 * WIDTH - 1)).to_bytes(WIDTH, "big") if r[3] <= LOW or r[3] >= HIGH else b"" for r in out]
        return pa.table({"row": pa.array([r[0] for r in out], pa.int64()), "place": pa.array([r[1] for r in out], pa.int32()),
                         "vec_id": pa.array([r[2] for r in out], pa.int64()), "score": pa.array(score, pa.int64()), "beyond": pa.array(beyond, pa.binary())})

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, "row long, place int, vec_id long, score long, beyond binary")


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(score: int, beyond: bytes) -> int:
    return int.from_bytes(beyond, "big") - (1 << 8 * WIDTH - 1) if beyond else score


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``embeddings``
    (vec_id, embedding, label). Anchors are the rows whose vec_id is divisible by ``every``; their
    positives are the best other rows of their label, negatives the best rows of other labels with
    low * positive <= 100 * negative <= high * positive. Rows with a null id or label, or a vector
    that is null or holds a null or a non-finite component, take no part. Only vectors of the
    anchor's dimension are compared; rows with the anchor's id are not its positives. Repeated
    rows count each, equal ones in turn, and repeated anchors are answered each. Scores beyond 64
    bits are compared exactly and shown as the last 64-bit number. Without anchors the result is
    empty."""
    rows = vectors(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0)
    first = best(in_grid(rows, anchors, lambda a: [Interval(positives)], True), ["row"], positives)
    found = stored(first.select("row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "beyond"), "positives")
    opened = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score", "beyond"))).alias("opened"))  # ``positives`` entries at most

    def windows(a: dict) -> list[Interval]:
        scores = [exact(p["positive_score"], p["beyond"]) for p in a["opened"]]
        return [Interval(negatives, -(-low * s // 100), high * s // 100) for s in scores]

    asked = stored(anchors.join(opened, "row"), "anchors")
    second = best(in_grid(rows, asked, windows, False), ["row", "place"], negatives).withColumn("place", F.col("place") + 1)
    named = second.select("row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return named.join(found.drop("beyond"), ["row", "place"]).join(ids, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
