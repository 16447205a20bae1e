"""Sorted hash arrays in the shared folder: written by tasks bucket by bucket, memory-mapped by workers, probed in numpy.

A key is hashed to 64 bits. Within a bucket the entries are sorted by hash; the leading bits say where to look, and of the
rest 32 bits are kept: a key that isn't there is taken for another with a probability of some 2^-32 a comparison, however
large the arrays. Values are counts of one byte each, larger ones aside.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa

from recollect.llm.arrays import U, mix


def save(path: str, array: np.ndarray) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts (below 2^32) in few bytes: differences by planes of bytes, compressed."""
    steps = np.diff(keys.view(U), prepend=U(0))
    raw = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 12 * n, codec="zstd"), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(U)[:, 0]
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(steps, dtype=U).view(np.int64), counts.astype(np.int64)


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Writer:
    """Appends buckets to the files of one part, which get their names when it is closed."""

    NAMES = ("rest", "value", "start", "lead", "where", "large")

    def __init__(self, path: str, width: int):
        self.path, self.width, self.own = path, width, f"{path}.{uuid.uuid4().hex}.tmp"
        self.files = {x: open(f"{self.own}.{x}", "wb") for x in self.NAMES}
        self.rows = self.cells = 0

    def add(self, bucket: int, keys: np.ndarray, values: np.ndarray) -> None:
        """keys of a bucket, in any order, and their values, a row of `width` whole numbers each."""
        h = mix(keys.view(U))
        order = np.argsort(h)
        h, values = h[order], values.reshape(len(keys), self.width)[order]
        lead = max(1, len(keys).bit_length() - 3)
        start = np.searchsorted(h, np.arange(1, 1 << lead, dtype=U) << U(64 - lead))
        put = lambda name, array, kind: self.files[name].write(array.astype(kind).tobytes())
        put("rest", (h << U(lead)) >> U(32), "<u4")
        large = np.flatnonzero((values > 254).any(1))
        small = np.minimum(values, 254)
        small[large] = 255
        put("value", small, np.uint8)
        put("where", large + self.rows, "<i8")
        put("large", values[large], "<i8")
        put("start", np.concatenate([[0], start, [len(keys)]]), "<u4")
        put("lead", np.array([bucket, lead, self.cells, self.rows]), "<i8")
        self.rows += len(keys)
        self.cells += (1 << lead) + 1

    def close(self) -> None:
        for name, f in self.files.items():
            f.close()
            os.replace(f"{self.own}.{name}", f"{self.path}.{name}")


class Part:
    """One part's files, mapped into memory."""

    def __init__(self, path: str, width: int):
        def load(name, kind, columns):
            size = os.path.getsize(f"{path}.{name}")
            return np.memmap(f"{path}.{name}", kind, "r").view(np.ndarray).reshape(-1, columns) if size else np.zeros((0, columns), kind)

        self.rest, self.start, self.where = (load(x, k, 1)[:, 0] for x, k in (("rest", "<u4"), ("start", "<u4"), ("where", "<i8")))
        self.value, self.large = load("value", np.uint8, width), load("large", "<i8", width)
        at = np.array(load("lead", "<i8", 4))
        at = at[np.argsort(at[:, 0])]
        self.buckets, self.lead, self.cell, self.row = at[:, 0], at[:, 1].astype(U), at[:, 2], at[:, 3]

    def get(self, bucket: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The values of hashed keys in their buckets; zeros where there is none."""
        out = np.zeros((len(h), self.value.shape[1]), np.int64)
        if not len(self.buckets):
            return out
        b = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        lead = self.lead[b]
        cell = self.cell[b] + (h >> (U(64) - lead)).astype(np.int64)
        todo = np.flatnonzero(self.buckets[b] == bucket)
        base = self.row[b]
        at, end, want = base[todo] + self.start[cell[todo]], base[todo] + self.start[cell[todo] + 1], ((h << lead) >> U(32)).astype(np.uint32)[todo]
        found = np.full(len(h), -1)
        while len(todo):
            live = at < end
            if not live.all():
                todo, at, end, want = todo[live], at[live], end[live], want[live]
            hit = self.rest[at] == want
            found[todo[hit]] = at[hit]
            miss = ~hit
            todo, at, end, want = todo[miss], at[miss] + 1, end[miss], want[miss]
        some = np.flatnonzero(found >= 0)
        values = self.value[found[some]].astype(np.int64)
        big = np.flatnonzero(values[:, 0] == 255)
        if len(big):
            values[big] = self.large[np.searchsorted(self.where, found[some][big])]
        out[some] = values
        return out


class HashArrays:
    """All parts of one table: bucket b lies in part b // each. parts: those that have any entry."""

    def __init__(self, path: str, width: int, parts: list[int], each: int):
        self.parts, self.each, self.width = {p: Part(f"{path}-{p}", width) for p in parts}, each, width

    def get(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The values of keys, of which the bucket is given; zeros where there is none."""
        h, part = mix(keys.view(U)), bucket // self.each
        order = np.argsort(part.astype(np.int32), kind="stable")
        which, start = np.unique(part[order], return_index=True)
        out = np.zeros((len(keys), self.width), np.int64)
        for p, at in zip(which.tolist(), np.split(order, start[1:])):
            if p in self.parts:
                out[at] = self.parts[p].get(bucket[at], h[at])
        return out
