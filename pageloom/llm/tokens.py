"""Vectorised word handling shared by the operators.

A text is taken as its UTF-8 bytes inside an Arrow column. Words are runs of bytes other than
``\\x20`` and ``\\x09``-``\\x0D``, hashed to 64 bits with numpy over a whole slice of documents at
once. Nothing here keeps a table that grows with the input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 25  # of texts in a block, on average
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after every other id
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}
RELEASE_BYTES = 1 << 23  # of texts between two releases
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
_unreleased = 0


def released() -> None:
    """Gives free memory back to the system; a Python worker between two tasks would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64; base is odd, so that each power has an inverse."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES // 4)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some consecutive rows of a batch: rows lo..hi, their bytes, and where each row begins."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about ``limit`` bytes; a longer text is one slice. Nulls are empty."""
    global _unreleased
    _unreleased += column.nbytes
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary()) if not pa.types.is_null(chunk.type) else pa.nulls(len(chunk), pa.large_binary())
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        n = len(chunk)
        if n:
            _, offs, data = chunk.buffers()
            offs = np.frombuffer(offs, np.int64)[chunk.offset : chunk.offset + n + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
                hi = min(hi, n)
                yield Slice(base + lo, base + hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                lo = hi
        base += n
    if _unreleased >= RELEASE_BYTES:
        _unreleased = 0
        released()


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    doc: np.ndarray  # row within the slice
    first: np.ndarray  # for each row, its first word; one entry more than rows


def words(s: Slice, gap: np.ndarray = _SPACE) -> Words:
    """The words of each row; ``gap`` marks the bytes between words."""
    n = len(s.buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(s.hi - s.lo + 1, np.int64))
    solid = ~gap[s.buf]
    cut = np.zeros(n + 1, bool)
    cut[s.offsets] = True
    start = np.empty(n, bool)
    start[0] = solid[0]
    start[1:] = solid[1:] & (~solid[:-1] | cut[1:n])
    end = np.empty(n, bool)
    end[-1] = solid[-1]
    end[:-1] = solid[:-1] & (~solid[1:] | cut[1:n])
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(s.offsets, a, "right") - 1
    return Words(a, b, doc, np.searchsorted(doc, np.arange(s.hi - s.lo + 1)))


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    p = powers(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:], dtype=np.uint64)
    inverse = powers(pow(_BASE, -1, 1 << 64), len(buf) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(s: Slice, w: Words, lower: bool = False) -> np.ndarray:
    return spans_hash(_LOWER[s.buf] if lower else s.buf, w.start, w.end)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries of h, also where they cross a row's end."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(_STEP, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p, out=total[1:], dtype=np.uint64)
    return mix((total[k:] - total[:n]) * powers(pow(_STEP, -1, 1 << 64), len(h))[:n] + np.uint64(k))


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """doc_id as numbers; a null is NO_ID."""
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(NO_ID).to_numpy())


def id_array(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.int64(), mask=x == NO_ID)


def code_points(s: Slice) -> np.ndarray:
    """The number of code points of each row."""
    lead = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum((s.buf & 0xC0) != 0x80, out=lead[1:])
    return np.diff(lead[s.offsets])


def with_blocks(docs: DataFrame, per: int, name: str = "_block") -> tuple[DataFrame, int]:
    """Adds a block number made from doc_id, and returns how many blocks there are: about ``per`` rows and at most about
    BLOCK_BYTES of text have the same one, however many there are. Rows without an id are dealt by their text."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    n = max(1, -(-rows // per), -(-(size or 0) // BLOCK_BYTES))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.withColumn(name, F.pmod(key, F.lit(n)).cast("int")), n
