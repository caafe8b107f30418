"""Vectorised text kernels over Arrow string batches.

The kernels work on the UTF-8 bytes of many documents at once. Words are runs
of bytes that are not ASCII white space (0x09-0x0D and 0x20). A word is hashed
with a positional polynomial over a table of random 64-bit values, so that one
cumulative sum gives the hash of every word. Documents are cut into chunks of
about ``CHUNK_BYTES`` so that memory stays bounded; one document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x += U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


BYTE_VALUES = splitmix(np.arange(256, dtype=U64) + U64(1000))
_MULTIPLIER = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII bytes that are neither letters nor digits also end a term.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([U64(1)], np.multiply.accumulate(np.full(size, _MULTIPLIER, U64))))
            _inverses = np.concatenate(([U64(1)], np.multiply.accumulate(np.full(size, _INVERSE, U64))))
    return _powers, _inverses


class Chunk:
    """Bytes of some documents: ``data`` (uint8) and ``bounds`` (one more than documents)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of whole documents of about ``limit`` bytes."""
    offsets, data = string_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Chunk(data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64), at)
        at = to


class Words:
    """Words of a chunk: byte ``start`` and ``end``, and ``first`` word of each document."""

    def __init__(self, chunk: Chunk, breaks: np.ndarray = WHITE):
        data, n = chunk.data, len(chunk.data)
        inside = ~breaks[data]
        edge = np.zeros(n + 1, bool)
        edge[chunk.bounds] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        begins = inside & (~before | edge[:n])
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, chunk.bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    powers, inverses = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=total[1:])
        return splitmix((total[words.end] - total[words.start]) * inverses[words.start])


def byte_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash for every window of n bytes (n at most 8)."""
    if len(data) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(data) - n + 1, U64)
    for i in range(n):
        out |= data[i : len(data) - n + 1 + i].astype(U64) << U64(8 * i)
    return splitmix(out)


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words that lies in one document, by its first word's index."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n - size + 1, U64)
        for i in range(size):
            out *= U64(_MULTIPLIER)
            out += hashes[i : n - size + 1 + i]
    doc = words.doc()
    same = doc[: n - size + 1] == doc[size - 1 :]
    at = np.flatnonzero(same)
    return splitmix(out[at]), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Cumulative count of code points before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
