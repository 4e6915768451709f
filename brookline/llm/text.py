"""Vectorised text primitives that the corpus operators share.

Everything here works on the raw Arrow buffers of a string column: words, hashes
and windows are numpy arrays over one chunk of documents, so no Python object is
made for a word. A chunk holds at most ``CHUNK_BYTES`` of text (a longer document
is a chunk by itself) and ``CHUNK_ROWS`` rows, which bounds the memory of a worker whatever the batch
size. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1 << 14

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_MULT = _U(0xD6E8FEB86659FD93)
_INV = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every output bit depends on every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        base = np.full(size, _MULT if kind == "mult" else _INV, dtype=_U)
        base[0] = _U(1)
        have = np.cumprod(base, dtype=_U)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values weighted by powers: the base of a rolling hash."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * _power("mult", len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) under prefix()."""
    return mix((sums[end] - sums[start]) * _power("inv", len(sums))[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


class Chunk(NamedTuple):
    """Some consecutive rows of a batch: their bytes, and where each row's begin and end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words of a chunk. first: index of each row's first word, with the total at the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1), at + rows)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(chunk: Chunk, lower: bool = False) -> Words:
    """Runs of bytes that are no ASCII white space; a word never crosses rows."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, _U))
    solid = ~SPACE[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | border[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | border[1:])) + 1
    sums = prefix((LOWER_CODE if lower else BYTE_CODE)[data])
    return Words(start, end, np.searchsorted(start, offsets), span_hash(sums, start, end))


class Grams(NamedTuple):
    """Hashes of n consecutive words; row: of each gram; at: index of its first word."""

    row: np.ndarray
    at: np.ndarray
    hash: np.ndarray


def grams(w: Words, n: int) -> Grams:
    count = np.diff(w.first)
    number = np.maximum(count - n + 1, 0)
    row = np.repeat(np.arange(len(count)), number)
    skip = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(len(row)) - skip[row] + w.first[row]
    return Grams(row, at, span_hash(prefix(w.hash), at, at + n))


def release() -> None:
    """Give memory that a task no longer uses back to the system, since workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def task(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The scan of a task, which gives its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            release()

    return run


def pieces(batch: pa.RecordBatch, text: str, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """The batch cut into slices of bounded text and rows, each with its chunk."""
    for chunk in chunks(batch.column(batch.schema.get_field_index(text)), rows=rows):
        yield batch.slice(chunk.first, chunk.rows), chunk
