"""Vectorised word hashing over the bytes of many texts at once (numpy, for use in Python workers)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of a-z, 0-9 and everything beyond ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {"n": np.zeros(0)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        with np.errstate(over="ignore"):
            up, down = np.full(n, _P, U64), np.full(n, _P_INVERSE, U64)
            up[0] = down[0] = 1
            _powers.update(n=np.empty(n, bool), up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    n = len(data)
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def lean(run):
    """A function over Arrow batches that gives freed memory back when its task ends: workers live on between stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


class Words:
    """The words of a run of texts: 64-bit hashes, byte spans and, for each text, its first word's index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        """data: lower-cased bytes; offsets: where each text starts, and the end."""
        n = len(data)
        inside = kind[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        filled = offsets[1:] > offsets[:-1]
        if n:
            before[offsets[:-1][filled]] = False
            after[offsets[1:][filled] - 1] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.first) - 1


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words; one for each start."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= _P
            out += hashes[k : k + n]
        return mixed(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows, and so many bytes of a text or binary column, at most; a longer value is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def word_chunks(column: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), CHUNK bytes at a time."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, to, Words(LOWER[data[offsets[row] : offsets[to]]], offsets[row : to + 1] - offsets[row], kind)
        row = to
