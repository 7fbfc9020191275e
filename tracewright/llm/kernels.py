"""Vectorised text kernels over Arrow buffers.

Python workers get whole Arrow batches.  The kernels below look at the UTF-8
bytes of a slice of rows at once, so that no Python code runs for a word or a
character.  Slices are bounded by SLICE_BYTES (one longer text is a slice of
its own), which bounds the memory of a worker whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(inside) -> np.ndarray:
    """A table over byte values: True where ``inside(value)`` holds."""
    return np.array([bool(inside(v)) for v in range(256)])


#: Bytes of ``[^\x20\x09-\x0D]``: all but ASCII white space.
NON_SPACE = byte_class(lambda v: v != 0x20 and not 0x09 <= v <= 0x0D)
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, non-ASCII.
ALNUM = byte_class(lambda v: 0x30 <= v <= 0x39 or 0x61 <= v <= 0x7A or v >= 0x80)
#: ASCII lower-casing of bytes.
LOWER = np.array([v + 32 if 0x41 <= v <= 0x5A else v for v in range(256)], dtype=np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text and ``rows`` rows, or one row."""
    _, at = utf8(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        high = min(high, low + rows, n)
        yield low, high
        low = high


class Words:
    """The words of a slice of texts.

    start, end: byte positions; doc: row of each word; first: n + 1 word
    offsets of the rows; hash: 64-bit hash of the word's bytes, on demand.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray, lower: bool = False):
        self.data, self.at = (LOWER[data] if lower else data), at
        held = inside[self.data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        before = np.empty_like(held)
        after = np.empty_like(held)
        if len(held):
            before[0], before[1:] = False, held[:-1]
            after[-1], after[:-1] = False, held[1:]
        self.start = np.flatnonzero(held & (cut[:-1] | ~before))
        self.end = np.flatnonzero(held & (cut[1:] | ~after)) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hash(self) -> np.ndarray:
        """A polynomial over the word's bytes modulo 2**64, by prefix sums, then mixed."""
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _tables[i] = table
    up, down = _tables
    if len(up) > 4 * SLICE_BYTES:  # a very long text's tables are not kept
        _tables[0] = _tables[1] = np.ones(1, np.uint64)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive items (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:n] + np.uint64(width))
    for k in range(1, width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n])
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def row_sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges between consecutive positions ``at``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` after lower-casing: a-z, non-ASCII.
LETTERS = byte_class(lambda v: 0x61 <= v <= 0x7A or v >= 0x80)


def terms(column: pa.Array, inside: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased terms of a slice of texts: distinct ones, and each (row, term) as row, index of the term and count.

    Terms are told apart by their bytes, not by hashes.
    """
    words = Words(*utf8(column), inside, lower=True)
    ends = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.end - words.start, out=ends[1:])
    packed = np.ascontiguousarray(words.data[inside[words.data]])
    all_terms = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(packed)).dictionary_encode()
    distinct = all_terms.dictionary
    code = all_terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, counts = np.unique(words.doc * max(len(distinct), 1) + code, return_counts=True)
    return distinct.cast(pa.string()), keys // max(len(distinct), 1), keys % max(len(distinct), 1), counts
