"""Removal of repeated passages: a count-min prefilter, then exact grouping.

A window is ``size`` consecutive words of a text. First round: every chunk counts its windows in a
two-row count-min sketch; the sketches of all chunks are merged slice by slice, and each chunk
learns which of its cells hold two or more windows of the corpus. Cells can only overestimate, so
a window with a cell of one is unique and drops out, and no repeated window is lost. Second
round: windows whose cells are both repeated are grouped exactly, by a 128-bit identity, and each
chunk learns which of its windows start first. Third: words covered by other windows go.

A sketch row has as many cells as the corpus has bytes, in slices of bounded size; no part of
it is broadcast or held whole anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harvestline.llm import vectext as vt
from harvestline.llm.chunks import CHUNK_BYTES, chunked, id_array, pack, texts, unpack

U = np.uint64
SIZE = 20
BANK = 40


class Windows:
    """The distinct windows of a chunk in the order of their hash, and where they occur. Texts
    without an id take no part."""

    def __init__(self, group: pa.Table, size: int):
        self.ids, self.null, self.raw, self.off = texts(group)
        self.start, self.end, self.word_off = vt.words(self.raw, self.off)
        at, window_off = vt.window_rows(self.word_off, size)
        row = vt.rows_of(window_off)
        use = ~self.null[row]
        self.at, self.row = at[use], row[use]
        self.place = self.at - self.word_off[self.row]
        first = vt.windows(vt.span_hashes(self.raw, self.start, self.end, BANK), size, BANK + 2)
        second = vt.windows(vt.span_hashes(self.raw, self.start, self.end, BANK + 1), size, BANK + 3)
        h1, h2 = (first[self.at], second[self.at]) if len(self.at) else (first[:0], second[:0])
        order = np.lexsort((h2, h1))  # stable: occurrences of a window stay in order of id and place
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begins = np.flatnonzero(new)
        self.h1, self.h2 = a[begins], b[begins]
        self.count = np.diff(np.append(begins, len(order)))
        self.first = order[begins]                      # occurrence that starts first within the chunk
        self.window = np.empty(len(order), np.int64)    # occurrence -> distinct window
        self.window[order] = np.cumsum(new) - 1

    def cells(self, bits: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each sketch row: the sorted cells in use, their counts up to two, and the cell of
        each distinct window as a place among them."""
        out = []
        for h in (self.h1, self.h2):
            cell, place = np.unique(h >> U(64 - bits), return_inverse=True)
            out.append((cell.astype(np.int64), np.minimum(np.bincount(place, self.count, minlength=len(cell)), 2).astype(np.uint8), place))
        return out


def bits_of(flags: np.ndarray) -> bytes:
    return pack(np.packbits(flags).tobytes())


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack(data), np.uint8), count=n).astype(bool)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as differences in the fewest whole bytes, compressed."""
    step = np.diff(values, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if not len(step) or int(step.max()) < 1 << (8 * w) or w == 8)
    return bytes([width]) + pack(step.astype(f"<u{width}").tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpack(data[1:]), f"<u{data[0]}").astype(np.int64))


def sliced(values: np.ndarray, width: int, slices: int) -> np.ndarray:
    """Borders of equal value ranges in a sorted array, slices + 1 places."""
    return np.searchsorted(values, np.arange(slices + 1) * width)


QUESTION = "part int, chunk int, a binary, b binary, c binary, d binary"
ANSWER = "chunk int, part int, kind int, bits binary"


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    names, types = zip(*(c.strip().split(" ") for c in schema.split(",")))
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, list(zip(*rows)) or [()] * len(names))})


def merge_cells(group: pa.Table) -> pa.Table:
    """Adds up one slice of one sketch row over all chunks; answers each with the flags of its
    cells that hold two or more windows."""
    rows = group.select(["part", "chunk", "a", "b"]).to_pylist()
    cells = [unpack_sorted(r["a"]) for r in rows]
    counts = [np.where(flags_of(r["b"], len(c)), 2, 1) for r, c in zip(rows, cells)]
    _, place = np.unique(np.concatenate(cells), return_inverse=True)
    repeated = np.bincount(place, np.concatenate(counts))[place] >= 2
    border = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
    return table_of(ANSWER, [(r["chunk"], r["part"], 0, bits_of(repeated[i:j])) for r, i, j in zip(rows, border, border[1:])])


def first_windows(group: pa.Table) -> pa.Table:
    """Groups one slice of the candidate windows exactly; answers each chunk with the flags of
    those whose first occurrence in the corpus is its own."""
    rows = group.select(["part", "chunk", "a", "b", "c", "d"]).to_pylist()
    h1, h2 = (np.concatenate([np.frombuffer(unpack(r[k]), "<u8") for r in rows]) for k in ("a", "b"))
    doc, place = (np.concatenate([np.frombuffer(unpack(r[k]), "<i8") for r in rows]) for k in ("c", "d"))
    order = np.lexsort((place, doc, h2, h1))
    a, b, c, d = h1[order], h2[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begins = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.empty(len(order), bool)
    first[order] = (c == c[begins]) & (d == d[begins])
    sizes = [len(unpack(r["a"])) // 8 for r in rows]
    border = np.concatenate([[0], np.cumsum(sizes)])
    return table_of(ANSWER, [(r["chunk"], r["part"], 1, bits_of(first[i:j])) for r, i, j in zip(rows, border, border[1:])])


def remove_repeats(docs: DataFrame, size: int = SIZE, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, the SHA-256 of the kept words
    joined by one space, and (``with_text``) that text. Null texts have no words. A row with a
    null doc_id has no place in the order of documents: it is left whole and its windows count for
    no other. Rows that share a doc_id are one document told several times; of windows that start
    at the same word of it none is earlier."""
    chunks = chunked(docs, chunk_bytes)
    n = chunks.chunks
    bits = int(np.clip(int(max(chunks.text_bytes, 1)).bit_length(), 20, 44))
    width = -(-(1 << bits) // n)       # cells of a slice; row 0 has slices 0 .. n-1, row 1 has n .. 2n-1
    hash_width = -(-(1 << 32) // n)    # candidates are sliced by the upper half of their hash

    def ask_cells(group: pa.Table) -> pa.Table:
        rows = []
        for r, (cell, count, _) in enumerate(Windows(group, size).cells(bits)):
            border = sliced(cell, width, n)
            rows += [(r * n + s, group.column("chunk")[0].as_py(), pack_sorted(cell[i:j] - s * width), bits_of(count[i:j] > 1), b"", b"")
                     for s, (i, j) in enumerate(zip(border, border[1:])) if j > i]
        return table_of(QUESTION, rows)

    def candidates(w: Windows, answer: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Places of the distinct windows both of whose cells are repeated."""
        both = np.ones(len(w.h1), bool)
        for r, (cell, _, place) in enumerate(w.cells(bits)):
            border = sliced(cell, width, n)
            flags = [flags_of(answer[0, r * n + s], j - i) for s, (i, j) in enumerate(zip(border, border[1:])) if j > i]
            both &= (np.concatenate(flags) if flags else np.zeros(0, bool))[place]
        return np.flatnonzero(both)

    def answers_in(table: pa.Table) -> dict[tuple[int, int], bytes]:
        return {(r["kind"], r["part"]): r["bits"] for r in table.select(["kind", "part", "bits"]).to_pylist()}

    def slices_of(w: Windows, found: np.ndarray) -> np.ndarray:
        return sliced((w.h1[found] >> U(32)).astype(np.int64), hash_width, n)

    def ask_first(group: pa.Table, answer: pa.Table) -> pa.Table:
        w = Windows(group, size)
        found = candidates(w, answers_in(answer))
        at = w.first[found]
        columns = (w.h1[found], w.h2[found], w.ids[w.row[at]].astype("<i8"), w.place[at].astype("<i8"))
        border = slices_of(w, found)
        return table_of(QUESTION, [(s, group.column("chunk")[0].as_py(), *[pack(c[i:j].tobytes()) for c in columns])
                                   for s, (i, j) in enumerate(zip(border, border[1:])) if j > i])

    def remove(group: pa.Table, answer: pa.Table) -> pa.Table:
        w, known = Windows(group, size), answers_in(answer)
        found = candidates(w, known)
        border = slices_of(w, found)
        flags = [flags_of(known[1, s], j - i) for s, (i, j) in enumerate(zip(border, border[1:])) if j > i]
        repeat = np.zeros(len(w.h1), bool)     # distinct windows that start earlier in another chunk
        repeat[found] = ~np.concatenate(flags) if flags else False
        home = w.first[w.window]               # for each occurrence the first one of its window in the chunk
        gone = repeat[w.window] | (w.ids[w.row] != w.ids[w.row[home]]) | (w.place != w.place[home])
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, w.at[gone], 1)
        np.add.at(cover, w.at[gone] + size, -1)
        kept = np.cumsum(cover)[:len(w.start)] == 0
        # bytes of kept words and one space behind each
        raw = w.raw.copy()
        inside = ~vt.SPACE[raw]
        mask = np.zeros(len(raw), bool)
        mask[inside] = np.repeat(kept, w.end - w.start)
        text_end = w.off[1:][vt.rows_of(w.word_off)] if len(w.start) else w.end
        behind = w.end[kept & (w.end < text_end)]
        raw[behind], mask[behind] = 0x20, True
        out, at = raw[mask].tobytes(), np.concatenate([[0], np.cumsum(mask)])[w.off]
        texts_out = [out[i:j].removesuffix(b" ") for i, j in zip(at, at[1:])]
        columns = {"doc_id": id_array(w.ids, w.null), "n_words": pa.array(np.diff(w.word_off), pa.int64()),
                   "n_removed": pa.array(vt.per_row(~kept, w.word_off), pa.int64()),
                   "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts_out], pa.string())}
        if with_text:
            columns["kept_text"] = pa.array([t.decode() for t in texts_out], pa.string())
        return pa.table(columns)

    by_chunk = chunks.rows.groupBy("chunk")
    cells = by_chunk.applyInArrow(ask_cells, QUESTION).repartition(n, "part").groupBy("part").applyInArrow(merge_cells, ANSWER)
    to_chunk = cells.repartition(n, "chunk")
    exact = by_chunk.cogroup(to_chunk.groupBy("chunk")).applyInArrow(ask_first, QUESTION).repartition(n, "part").groupBy("part").applyInArrow(first_windows, ANSWER)
    everything = to_chunk.union(exact).repartition(n, "chunk")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return by_chunk.cogroup(everything.groupBy("chunk")).applyInArrow(remove, schema)
