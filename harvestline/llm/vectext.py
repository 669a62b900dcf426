"""Words, lines and their hashes over the bytes of many texts at once (NumPy, inside tasks).

A text is a run of bytes ``raw[off[i]:off[i + 1]]``. Words are runs without the ASCII white
space 0x20, 0x09 to 0x0D. Hashes are 64-bit polynomials over random byte values, mixed at the
end; ``bank`` selects an independent one, so that two of them make a 128-bit identity.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=None)
def constants(bank: int) -> tuple[np.ndarray, np.uint64]:
    """Random value of each byte and an odd multiplier."""
    rng = np.random.Generator(np.random.PCG64(1000 + bank))
    values = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
    return values, rng.integers(1, 2**63 - 1, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=8)
def _powers(bank: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(size - 1, constants(bank)[1], np.uint64), out=out[1:])
    return out


def powers(bank: int, size: int) -> np.ndarray:
    return _powers(bank, 1 << max(6, int(size - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of True that does not cross a text, and for each text
    the range of its runs (an array of offsets)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[raw], off)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, bank: int, block: int = 1 << 16) -> np.ndarray:
    """Hash of each of the disjoint spans, in order; a block of spans at a time."""
    out = np.zeros(len(start), np.uint64)
    values, _ = constants(bank)
    for at in range(0, len(start), block):
        first_byte, lengths = start[at:at + block], end[at:at + block] - start[at:at + block]
        total = int(lengths.sum())
        if not total:
            continue
        first = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(first, lengths)
        chars = raw[place + np.repeat(first_byte, lengths)]
        terms = values[chars] * powers(bank, int(lengths.max()) + 1)[place]
        filled = np.flatnonzero(lengths > 0)
        out[at + filled] = np.add.reduceat(terms, first[filled])
    return mix(out)


def windows(h: np.ndarray, size: int, bank: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values (over the whole array; drop those that cross
    a text with ``window_rows``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, factor = constants(bank)
    out = h[:n].copy()
    for k in range(1, size):
        out *= factor
        out += h[k:k + n]
    return mix(out)


def window_rows(word_off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (first word) of the windows that lie within one text, and the offsets of
    each text's windows among them."""
    counts = np.maximum(np.diff(word_off) - size + 1, 0)
    off = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(off[-1]) - np.repeat(off[:-1], counts) + np.repeat(word_off[:-1], counts)
    return place, off


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def rows_of(off: np.ndarray) -> np.ndarray:
    """The text each element belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
