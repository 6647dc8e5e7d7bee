"""Vectorised text helpers used inside Arrow tasks: words, word hashes and word windows over whole columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` bytes of the UTF-8 text. Every helper works on the
flat byte buffer of an Arrow string column, so the cost is a few numpy passes a byte and no Python
object is made for a word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass works on; a longer text forms a pass of its own.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LANES = 64
_TABLES: dict[int, np.ndarray] = {}
_POWERS = mix64(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        first = np.uint64(seed * _LANES * 256 + 1)
        _TABLES[seed] = mix64((np.arange(_LANES * 256, dtype=np.uint64) + first) * np.uint64(0x9E3779B97F4A7C15))
    return _TABLES[seed]


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each (at least one row)."""
    _, offsets = flat_text(column)
    start, rows = 0, len(column)
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(rows, max(start + 1, stop))
        yield start, stop
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row (rows + 1 entries)."""
    n = len(data)
    inside = np.zeros(n + 2, np.bool_)
    inside[1 : n + 1] = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 2, np.bool_)
    first[offsets + 1] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | first[1 : n + 1]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2 : n + 2] | first[2 : n + 2])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit tabulation hash of each word, a pure function of its bytes; another seed gives an independent one.

    Bytes are looked up by their place in a block of 64, blocks have odd multipliers of their own.
    """
    table = _table(seed)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        lengths = ends[i:j] - starts[i:j]
        heads = np.zeros(j - i, np.int64)
        np.cumsum(lengths[:-1], out=heads[1:])
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        values = table[(place & (_LANES - 1)) * 256 + data[np.repeat(starts[i:j], lengths) + place]]
        if int(lengths.max()) > _LANES:
            blocks = mix64(np.arange(1, int(lengths.max()) // _LANES + 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
            blocks[0] = 1  # else short words would hash otherwise where a long one is near
            values *= blocks[place // _LANES]
        out[i:j] = np.add.reduceat(values, heads) + lengths.astype(np.uint64) * _POWERS[31]
        i = j
    return mix64(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive words; entry i starts at word i (rows are not regarded)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _POWERS[0]
    for k in range(1, size):
        out += words[k : k + n] * _POWERS[k]
    return mix64(out)


def window_rows(bounds: np.ndarray, size: int, n_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row, and the row of each."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    heads = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=heads[1:])
    return np.arange(int(counts.sum())) - np.repeat(heads, counts) + np.repeat(bounds[:-1], counts), rows


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, lower-cased: the flat sorted hashes and the bounds of the rows.

    A text with fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = flat_text(column)
    data = lower_ascii(data)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    at, rows = window_rows(bounds, size, 0)
    full = window_hashes(words, size)
    hashes = full[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(bounds)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = np.array([mix64(np.array([int((words[bounds[r] : bounds[r + 1]] * _POWERS[: counts[r]]).sum()) ^ (0xABCDEF + int(counts[r]))], np.uint64))[0] for r in few], np.uint64)
        hashes, rows = np.concatenate([hashes, short]), np.concatenate([rows, few])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), np.bool_)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.searchsorted(rows, np.arange(len(counts) + 1))


def blob_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
