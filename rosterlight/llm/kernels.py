"""Array kernels over Arrow text batches: words, word hashes and shingles without a Python loop per word.

A hash here is a 64-bit polynomial of a word's bytes, finished by two multiply-and-shift rounds.
It depends on the bytes only, so it is the same in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8), at.astype(np.int64)


def slices(at: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes each; a longer row is a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside`` true that stay in one row, and how many runs each row has.

    ``at`` holds the rows' offsets in ``data``.
    """
    low = int(at[0])
    w = inside[data[low : int(at[-1])]]
    edge = np.empty(len(w) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = w[1:] != w[:-1]
    edge[at - low] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    good = w[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[good] + low, ends[good] + low
    return starts, ends, np.diff(np.searchsorted(starts, at))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, in chunks, so that a huge text needs no huge array of powers."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    total = np.cumsum(size)
    powers = np.full(max(1, int(size.max())), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    first = 0
    while first < len(starts):
        base = int(total[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(total, base + _CHUNK, side="right")))
        n = size[first:last]
        heads = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(heads, n)
        terms = (data[np.repeat(starts[first:last], n) + within].astype(np.uint64) + np.uint64(1)) * powers[within]
        out[first:last] = np.add.reduceat(terms, heads) + n.astype(np.uint64)
        first = last
    return mix(out)


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned hashes; their order counts."""
    h = mix(parts[0])
    for x in parts[1:]:
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + x)
    return h


def row_shingles(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``words`` words, A-Z lower-cased; a row with fewer words has one, of all of them; without a word, none."""
    data, at = text_buffers(column)
    data = LOWER[data]
    for first, last in slices(at):
        starts, ends, counts = word_spans(data, at[first : last + 1], ~SPACE)
        h = span_hashes(data, starts, ends)
        n = max(0, len(h) - words + 1)
        grams = chained([h[i : i + n] for i in range(words)]) if n else h[:0]
        begin = 0
        for k in counts.tolist():
            if k >= words:
                yield np.unique(grams[begin : begin + k - words + 1])
            elif k:
                yield chained([h[i : i + 1] for i in range(begin, begin + k)] + [np.full(1, k, np.uint64)])
            else:
                yield h[:0]
            begin += k
