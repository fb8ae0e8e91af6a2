"""Words of whole texts as numpy arrays, straight from Arrow string buffers.

A column of texts is one byte buffer with row offsets. Word boundaries, 64-bit word hashes and hashes of
runs of words come from array operations over that buffer; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: True for the bytes that part words: space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: True for ASCII bytes that are neither letters nor digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_UNSTEP = pow(_STEP, -1, 1 << 64)
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _STEP, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks may keep chunks of an empty column
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a column with about ``size`` bytes of text each; one long text stands alone."""
    _, at = flat(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, column.slice(row, stop - row)
        row = stop


def spans(buf: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one more than rows)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~blank[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal bytes give equal hashes in any batch."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)
    if lower:
        table = table[LOWER]
    out = np.empty(len(start), np.uint64)
    power = _powers(_PIECE)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _PIECE, "right")))
        s, e = start[a:b] - start[a], end[a:b] - start[a]
        n = int(e[-1])
        p = power if n <= len(power) else _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[buf[start[a] : end[b - 1]]] * p[:n], out=total[1:])
        back = np.uint64(pow(_UNSTEP, n - 1, 1 << 64))
        out[a:b] = (total[e] - total[s]) * p[n - 1 - s] * back
        a = b
    return mix(out)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run h[i:i+k]; shorter than h by k-1, and empty if h is too short.

    A run of 2n values is put together from two runs of n, so the work grows with the logarithm of k.
    """
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, size = None, 0
    part, width = h, 1
    while True:
        if k & width:
            if out is None:
                out, size = part, width
            else:  # the run goes on with what has been put together so far
                n = len(h) - (width + size) + 1
                out = part[:n] * np.uint64(pow(_STEP, size, 1 << 64)) + out[width : width + n]
                size += width
        if size == k:
            return mix(out)
        n = len(part) - width
        part = part[:n] * np.uint64(pow(_STEP, width, 1 << 64)) + part[width:]
        width *= 2


def sliding(x: np.ndarray, k: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) over each x[i:i+k]; shorter than x by k-1."""
    width = 1
    while width * 2 <= k:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = k - width
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def row_ends(first: np.ndarray) -> np.ndarray:
    """For each word, the index after the last word of its row."""
    return np.repeat(first[1:], np.diff(first))


def texts_words(column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a whole column and the index of each row's first word, made piece by piece."""
    found, first = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    n = 0
    for _, piece in chunks(column):
        buf, at = flat(piece)
        s, e, f = spans(buf, at, blank)
        found.append(word_hashes(buf, s, e, lower))
        first.append(f[1:] + n)
        n += len(s)
    return np.concatenate(found), np.concatenate(first)
