"""Vectorised text primitives over Arrow string columns.

A batch of texts is viewed as one UTF-8 byte buffer with document offsets;
words, lines and fixed windows are then spans of that buffer and are hashed
with numpy prefix sums, without creating a Python object per token.  All
functions are pure and deterministic across processes: the tables below come
from a fixed seed.

Nulls read as empty texts.  Batches are cut into slices of about
``SLICE_BYTES`` so that memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII white space: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~IS_SPACE
#: ASCII letters and digits, and every byte of a non-ASCII character.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


class _Powers:
    """Cached powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS[which].get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


class SpanHash:
    """64-bit hashes of byte spans ``buf[start:end]`` of one buffer."""

    def __init__(self, buf: np.ndarray, which: int = 0) -> None:
        self.p, self.down = _prefix(_BYTE[buf], which)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.p[end] - self.p[start]) * self.down[start] + (end - start).astype(np.uint64))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans ``buf[start:end]``."""
    return SpanHash(buf, which)(start, end) if len(start) else np.zeros(0, np.uint64)


def hash_windows(values: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """Hash of each ``length`` consecutive 64-bit values, by start position."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    p, down = _prefix(values, which)
    n = len(values) - length + 1
    return mix((p[length:] - p[:n]) * down[:n] + np.uint64(length))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds one row, or at most ``limit`` bytes of ``column`` (``SLICE_BYTES`` where none are given)."""
    limit = limit or SLICE_BYTES
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, never crossing documents.

    Returns starts, exclusive ends, and for each document the index of its
    first span (with the total appended).
    """
    m = inside[buf]
    first, last = m.copy(), m.copy()
    if len(m):
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        edge = offs[(offs > 0) & (offs < len(m))]
        first[edge] = m[edge]
        last[edge - 1] = m[edge - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark longs, bit for bit."""
    return h.view(np.int64)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each element described by ``offsets``, the index of its document."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each different value, in ascending order of value, and for each value the number of its like."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def pack_columns(a: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(a[c]).tobytes() for c in a.dtype.names)


def unpack_columns(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of all blobs, in their order."""
    out = np.empty(sum(map(len, blobs)) // kind.itemsize, kind)
    at = 0
    for b in blobs:
        n, pos = len(b) // kind.itemsize, 0
        for c in kind.names:
            size = kind[c].itemsize * n
            out[c][at : at + n] = np.frombuffer(b[pos : pos + size], kind[c])
            pos += size
        at += n
    return out
