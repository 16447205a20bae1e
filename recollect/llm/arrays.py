"""Vectorised text primitives over Arrow buffers: word boundaries, word hashes, n-gram hashes, minimum hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.plans.shared import ship

#: Bytes of text worked on at once, so that the temporaries stay in the cache; a longer document is one piece.
PIECE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = {"base": np.ones(1, U), "inverse": np.ones(1, U)}

#: Bytes that belong to a word. Plain: all but white space and control characters. Letters: letters and digits, and all of non-ASCII.
PLAIN = np.arange(256) > 32
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(function, schema), with this package on the workers. Spark bounds the bytes of a batch; functions slice it further where they make more of it."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_pow[kind]) < n:
        p = np.full(max(n, 1 << 16), _BASE if kind == "base" else _INVERSE, U)
        p[0] = 1
        _pow[kind] = np.multiply.accumulate(p)
    return _pow[kind][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array):
    """Yield (first row, last row + 1, bytes, offsets from 0) for runs of whole documents of about PIECE bytes."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every document the number of its first word (one entry more at the end)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    before[:-1] = inside[1:]
    before[-1] = False
    before[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    sums[1:] = _BYTE[data]
    sums[1:] *= _powers("base", n)
    np.cumsum(sums, out=sums)
    h = sums[ends] - sums[starts]
    h *= _powers("inverse", n + 1)[starts]
    return mix(h)


def grams(h: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each document, and each document's first n-gram (one entry more).

    short: a document of 1 to n-1 words has one n-gram, of all its words; else it has none.
    """
    counts = np.diff(first)
    have = np.maximum(counts - n + 1, ((counts > 0) if short else (counts < 0)).astype(np.int64))
    off = np.zeros(len(first), np.int64)
    np.cumsum(have, out=off[1:])
    if off[-1] == 0:
        return np.zeros(0, U), off
    pos = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], have)
    sums = np.zeros(len(h) + 1, U)
    np.multiply(h, _powers("base", len(h)), out=sums[1:])
    np.cumsum(sums, out=sums)
    end = pos + n
    if short:
        end = np.minimum(end, np.repeat(first[1:], have))
    g = (sums[end] - sums[pos]) * _powers("inverse", len(h) + 1)[pos]
    return mix(g), off


def minimum_hashes(h: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """k minimum hashes of each document's set of hashes, as uint32; all ones where the set is empty."""
    rng = np.random.default_rng(k)
    turn, times = rng.integers(0, 1 << 32, (2, k), dtype=np.uint64).astype(np.uint32)
    times |= np.uint32(1)
    full = np.flatnonzero(np.diff(off))
    sig = np.full((len(off) - 1, k), 0xFFFFFFFF, np.uint32)
    if len(full):
        low, at = (h >> U(32)).astype(np.uint32), off[:-1][full]
        for j in range(k):
            sig[full, j] = np.minimum.reduceat((low ^ turn[j]) * times[j], at)
    return sig


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts as numbers, and each text's first (one entry more)."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b = padded[start]
    size = 1 + (b >= 0xC0).astype(np.int8) + (b >= 0xE0) + (b >= 0xF0)
    c = np.where(size == 1, b, b & (np.uint32(0x7F) >> size.astype(np.uint32)))
    for k in (1, 2, 3):
        c = np.where(size > k, c << np.uint32(6) | padded[start + k] & 63, c)
    return c.astype(np.uint32), np.searchsorted(start, at)


def binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())
