"""Interpolated modified Kneser-Ney n-gram model over words, and the perplexity of documents (operator 4)."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import hash_arrays
from recollect.llm.arrays import LETTERS, U, map_batches, mix, pieces, span_hashes, words
from recollect.plans.shared import local_path, shared_path, stage

#: Symbols of an n-gram. A symbol is a word of the vocabulary, from WORD on; elsewhere a byte of UTF-8 plus 1; 0 before a text's begin, or END behind its last byte.
ORDER = 3
END, WORD = 257, 258
#: Bits of a symbol without and with words: three with words are 63 bits, so that every n-gram has a number of its own.
_BYTE_BITS, _WORD_BITS = 9, 21
#: Words of the vocabulary at most, the most frequent ones; a word that occurs once in the corpus isn't in it.
WORDS = (1 << _WORD_BITS) - WORD
#: Symbols of text for each bucket of n-grams, which one task holds at a time; files of each order at most; n-grams a task adds up before it sends them.
BUCKET, FILES, HELD = 1 << 21, 1024, 2_500_000
#: Slices of the tables by symbol.
SLICES = 16


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word: letters and digits, with the space before them where there is one."""
    starts, ends, first = words(data, at, LETTERS)
    begin = np.repeat(at[:-1], np.diff(first))
    starts = starts - ((starts > begin) & (data[np.maximum(starts - 1, 0)] == 32))
    return starts, ends, span_hashes(data, starts, ends)


def vocabulary(docs: DataFrame, most: int = WORDS) -> tuple[str, int, int]:
    """The folder of the model, symbols of the corpus and buckets; it holds the sorted hashes of the words that occur twice or more, as many of the most frequent as fit in, and over how many buckets what has one in its middle is spread."""

    def tally(batches):
        for b in batches:
            for _, _, data, at in pieces(b.column(0)):
                starts, ends, s = spans(data, at)
                h, first, c = np.unique(s, return_index=True, return_counts=True)
                size = (ends - starts)[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), 0), mask=np.arange(len(h) + 1) == len(h)), pa.array(np.append(c, len(data) + len(at) - 1)), pa.array(np.append(size, 0))], ["h", "c", "size"])

    counted = map_batches(docs.where("text is not null").select("text"), tally, "h long, c long, size long").groupBy("h").agg(F.sum("c").alias("c"), F.max("size").alias("size"))
    counted = stage(counted.where("c > 1 or h is null"), "words")
    every = counted.where("h is null").agg(F.sum("c")).first()[0] or 0
    known = counted.where("h is not null")
    least, total, saved = 0, 0, 0
    for c, n, size in sorted(((r.c, r.n, r.size) for r in known.groupBy("c").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()), reverse=True) if most else ():
        total += n
        if total > most:
            break
        least, saved = c, saved + c * (size - n)
    every -= saved
    buckets = max(1, -(-every // BUCKET))
    folder = local_path(shared_path(docs.sparkSession, "language-model"))
    os.makedirs(folder, exist_ok=True)

    def save(batches):
        held = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
        h, c = np.concatenate(held, 1)
        order = np.argsort(h.view(U))
        hash_arrays.save(f"{folder}/words.npy", h[order].view(U))
        hash_arrays.save(f"{folder}/spread.npy", np.ceil(c[order] * buckets / max(every, 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([len(h)])], ["n"])

    # at most `most` rows, so one task can hold them
    chosen = known.where(F.col("c") >= (least or 1 << 62)).select("h", "c").repartition(1)
    if not sum(r.n for r in chosen.mapInArrow(save, "n long").collect()):
        hash_arrays.save(f"{folder}/words.npy", np.zeros(0, U))
        hash_arrays.save(f"{folder}/spread.npy", np.zeros(0, np.int32))
    return folder, every, buckets


@lru_cache(maxsize=2)
def _words(folder: str) -> np.ndarray:
    return np.load(f"{folder}/words.npy", mmap_mode="r").view(np.ndarray)


@lru_cache(maxsize=2)
def _spread(folder: str) -> np.ndarray:
    return np.load(f"{folder}/spread.npy", mmap_mode="r").view(np.ndarray)


def symbols(data: np.ndarray, at: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents and each one's first (one entry more): words of the vocabulary, and every byte that is in none of them."""
    known, s = _words(folder), data.astype(np.int64) + 1
    if not len(known) or not len(data):
        return s, at
    starts, ends, h = spans(data, at)
    place = np.searchsorted(known, h)
    hit = known[np.minimum(place, len(known) - 1)] == h
    starts, ends = starts[hit], ends[hit]
    s[starts] = WORD + place[hit]
    rest = np.zeros(len(data) + 1, np.int8)
    rest[starts + 1] += 1
    rest[ends] -= 1
    keep = np.cumsum(rest[:-1], dtype=np.int8) == 0
    off = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=off[1:])
    return s[keep], off[at]


def bits(folder: str) -> int:
    return _WORD_BITS if len(_words(folder)) else _BYTE_BITS


def ngrams(s: np.ndarray, at: np.ndarray, order: int, width: int) -> np.ndarray:
    """One n-gram for every symbol of every document and for its end, as a number of order * width bits, in the order of the text."""
    n = len(at) - 1
    size = np.diff(at) + order  # order - 1 symbols before, the end behind
    base = np.cumsum(size) - size
    all_ = np.zeros(int(size.sum()), np.int64)
    all_[np.arange(len(s)) + np.repeat(base + order - 1 - at[:-1], np.diff(at))] = s
    all_[base + size - 1] = END
    key = all_.copy()
    for _ in range(order - 1):
        key = (key[:-1] << width) | all_[len(all_) - len(key) + 1 :]
    return key[all_[order - 1 :] > 0] if n else key[:0]


def _bucket(keys: np.ndarray, n: int, folder: str, buckets: int) -> np.ndarray:
    """The bucket of n-grams: by what is between the first and the last symbol, so that contexts and suffixes meet; frequent middles are spread by the first symbol.

    Of 2 symbols: by the first, spread by the last.
    """
    width = bits(folder)
    one = (1 << width) - 1
    first, middle = (keys >> width * (n - 1), keys >> width & ((1 << width * (n - 2)) - 1)) if n > 2 else (keys & one, keys >> width)
    leading = middle >> width * max(n - 3, 0)
    spread = np.full(len(keys), max(1, buckets // 8))  # bytes: how frequent isn't known
    word = leading >= WORD
    spread[word] = _spread(folder)[leading[word] - WORD]
    h = mix(middle.astype(U)) + mix(first.astype(U) + U(1 << 62)) % spread.astype(U)
    return (h % U(buckets)).astype(np.int32)


def _sent(keys: np.ndarray, counts: np.ndarray, n: int, folder: str, buckets: int):
    """Sorted n-grams and counts as a batch of (bucket, blob)."""
    b = _bucket(keys, n, folder, buckets)
    order = np.argsort(b, kind="stable")
    which, start = np.unique(b[order], return_index=True)
    own = np.split(order, start[1:])
    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([hash_arrays.pack(keys[i], counts[i]) for i in own], pa.binary())], ["bucket", "blob"])


def counted(docs: DataFrame, order: int, folder: str, buckets: int) -> DataFrame:
    """(bucket, blob): the n-grams of the corpus and how often they occur, added up by tasks."""
    width = bits(folder)

    def tally(batches):
        held, size = [], 0
        for b in batches:
            for _, _, data, at in pieces(b.column(0)):
                held.append(np.unique(ngrams(*symbols(data, at, folder), order, width), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield from _sent(*hash_arrays.merge(*map(np.concatenate, zip(*held))), order, folder, buckets)
                    held, size = [], 0
        if size:
            yield from _sent(*hash_arrays.merge(*map(np.concatenate, zip(*held))), order, folder, buckets)

    return map_batches(docs.where("text is not null").select("text"), tally, "bucket int, blob binary")


def _buckets_of(batches):
    """(bucket, keys, counts), merged, of blobs sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and b != bucket:
                yield bucket, *hash_arrays.merge(*map(np.concatenate, zip(*held)))
                held = []
            bucket = b
            held.append(hash_arrays.unpack(blob.as_py()))
    if held:
        yield bucket, *hash_arrays.merge(*map(np.concatenate, zip(*held)))


def _by_context(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of sorted n-grams, and for each the sum of counts, and how many counts are 1, 2 and more."""
    ctx = keys >> width
    new = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
    sums = [np.add.reduceat(x, new) for x in (counts, *((counts == i).astype(np.int64) for i in (1, 2)), (counts > 2).astype(np.int64))]
    return ctx[new], np.stack(sums, 1)


def _stored(blobs: DataFrame, n: int, folder: str, buckets: int, each: int) -> DataFrame:
    """Store the n-grams of all buckets, and their contexts; give the (n - 1)-grams and how many symbols precede each, as blobs, or with n = 2 the tables by symbol (slice, row, blob)."""
    width, size = bits(folder), WORD + len(_words(folder))
    parts = -(-buckets // each)

    def reduce(batches):
        grams = contexts = None
        stats, table, part = np.zeros(4, np.int64), None, None
        for bucket, keys, counts in _buckets_of(batches):
            if grams is None:
                part = bucket // each
                grams, contexts = hash_arrays.Writer(f"{folder}/grams{n}-{part}", 1), hash_arrays.Writer(f"{folder}/contexts{n}-{part}", 4) if n > 2 else None
                table = np.zeros((5, size), np.int64) if n == 2 else None
            grams.add(bucket, keys, counts)
            stats += np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            ctx, sums = _by_context(keys, counts, width)
            if n > 2:
                # one that is followed once is known by being an (n - 1)-gram, but for that of the beginning
                several = (sums[:, 0] > 1) | (ctx == 0)
                contexts.add(bucket, ctx[several], sums[several])
                low = np.sort(keys & ((1 << width * (n - 1)) - 1))
                yield from _sent(*np.unique(low, return_counts=True), n - 1, folder, buckets)
            else:
                table[0] += np.bincount(keys & ((1 << width) - 1), minlength=size)
                for row in range(4):
                    table[row + 1] += np.bincount(ctx, sums[:, row], size).astype(np.int64)
        if grams is not None:
            grams.close()
            if contexts is not None:
                contexts.close()
            hash_arrays.save(f"{folder}/stats{n}-{part}.npy", stats)
            if table is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([hash_arrays.pack(np.cumsum(x.ravel()), np.zeros(x.size, np.int64)) for x in np.array_split(table, SLICES, 1)], pa.binary())], ["bucket", "blob"])

    placed = blobs.repartitionById(parts, F.expr(f"bucket div {each}").cast("int")).sortWithinPartitions("bucket")
    return placed.mapInArrow(reduce, "bucket int, blob binary")


def _tables(blobs: DataFrame, folder: str) -> None:
    """Store for every symbol: the symbols that precede it, the sum of its context's counts, and how many of these are 1, 2 and more."""

    def add(batches):
        total, piece = None, None
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.diff(hash_arrays.unpack(blob.as_py())[0], prepend=0).reshape(5, -1)
                if piece is not None and s != piece:
                    hash_arrays.save(f"{folder}/table-{piece}.npy", total)
                    total = None
                piece, total = s, own if total is None else total + own
        if total is not None:
            hash_arrays.save(f"{folder}/table-{piece}.npy", total)
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    blobs.repartitionById(SLICES, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(add, "n long").collect()


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4; 0.5, 1, 1.5 where one of these is 0 or a discount isn't between 0 and its count (an unseen symbol would have no probability)."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(float(i - (i + 1) * y * n[i] / n[i - 1]) for i in (1, 2, 3))
    return d if all(0 < x < i for i, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


def fit(docs: DataFrame, order: int = ORDER, most: int = 0) -> list[str]:
    """Count and store the model, in one job after that of the vocabulary of at most `most` words (0: bytes alone); gives its folder.

    The highest order has its counts; a lower one counts the symbols that precede. The n-grams are shuffled once for each
    order, added up by tasks before and in few bytes each, by what is between their first and last symbol: so all that
    follows a context, and all that precedes a suffix, meet in one bucket (or in several, of which counts are added).
    """
    if order < 2 or order * (_WORD_BITS if most else _BYTE_BITS) > 63:
        raise ValueError("an n-gram has 2 symbols or more, and fits in 63 bits")
    folder, _, buckets = vocabulary(docs, most)
    each = -(-buckets // FILES)
    blobs = counted(docs, order, folder, buckets)
    for n in range(order, 1, -1):
        blobs = _stored(blobs, n, folder, buckets, each)
    _tables(blobs, folder)
    files = os.listdir(folder)
    found = {n: sum((np.load(f"{folder}/{f}") for f in files if f.startswith(f"stats{n}-")), np.zeros(4, np.int64)) for n in range(2, order + 1)}
    ones = [np.load(f"{folder}/table-{i}.npy")[0] if f"table-{i}.npy" in files else np.zeros(0, np.int64) for i in range(SLICES)]
    found[1] = np.bincount(np.minimum(np.concatenate(ones), 5), minlength=6)[1:5]
    with open(f"{folder}/model.json", "w") as f:
        json.dump({"order": order, "buckets": buckets, "each": each, "discounts": {n: discounts(c) for n, c in found.items()}}, f)
    return [folder]


class Model:
    """What fit stored: tables by symbol, and hash arrays that are mapped into memory."""

    def __init__(self, folder: str):
        with open(f"{folder}/model.json") as f:
            m = json.load(f)
        self.folder, self.order, self.buckets, self.width = folder, m["order"], m["buckets"], bits(folder)
        self.discounts = {int(n): np.array([0, *d]) for n, d in m["discounts"].items()}
        names, size = os.listdir(folder), WORD + len(_words(folder))
        table = [np.load(f"{folder}/table-{i}.npy") for i in range(SLICES) if f"table-{i}.npy" in names]
        before, self.total, *kinds = np.concatenate(table, 1) if table else np.zeros((5, size), np.int64)
        every = before.sum()
        less = self.discounts[1][np.minimum(before, 3)]
        self.own = (before - less) / max(every, 1) + (less.sum() / every if every else 1) / (size - 1)
        self.weight = np.where(self.total > 0, sum(d * x for d, x in zip(self.discounts[2][1:], kinds)) / np.maximum(self.total, 1), 1)
        each = m["each"]

        def arrays(name, width):
            return hash_arrays.HashArrays(f"{folder}/{name}", width, [p for p in range(-(-self.buckets // each)) if f"{name}-{p}.rest" in names], each)

        self.grams = {n: arrays(f"grams{n}", 1) for n in range(2, self.order + 1)}
        self.contexts = {n: arrays(f"contexts{n}", 4) for n in range(3, self.order + 1)}

    def count(self, keys: np.ndarray, n: int) -> np.ndarray:
        return self.grams[n].get(_bucket(keys, n, self.folder, self.buckets), keys)[:, 0]

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """p(last symbol | those before) of each n-gram of the highest order: from the lowest up, the part of its own and the weight of what is below; an unseen context changes nothing."""
        one = (1 << self.width) - 1
        p = self.own[keys & one]
        for n in range(2, self.order + 1):
            part = keys & ((1 << self.width * n) - 1)
            bucket = _bucket(part, n, self.folder, self.buckets)
            c, d = self.grams[n].get(bucket, part)[:, 0], self.discounts[n]
            ctx = part >> self.width
            if n == 2:
                total, weight = self.total[ctx], self.weight[ctx]
            else:
                # an n-gram and its context are in one bucket
                sums = self.contexts[n].get(bucket, ctx)
                once = np.flatnonzero((sums[:, 0] == 0) & (c == 0))
                once = np.concatenate([once[self.count(ctx[once], n - 1) > 0], np.flatnonzero((sums[:, 0] == 0) & (c > 0))])
                sums[once] = 1, 1, 0, 0
                total = sums[:, 0]
                weight = np.where(total > 0, sums[:, 1:] @ d[1:] / np.maximum(total, 1), 1)
            p = weight * p + (c - d[np.minimum(c, 3)]) / np.maximum(total, 1)
        return p


@lru_cache(maxsize=2)
def _load(model: tuple[str, ...]) -> Model:
    return Model(*model)


def probabilities(keys: np.ndarray, model: tuple[str, ...]) -> np.ndarray:
    return _load(model).probabilities(keys)


def scored(docs: DataFrame, model: list[str]) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) for every row: over all symbols of the text and its end, natural logarithm; null for a null text."""
    model = tuple(model)

    def score(batches):
        own = _load(model)
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, j, data, at in pieces(b.column(1)):
                s, at = symbols(data, at, model[0])
                size = np.diff(at) + 1
                n[i:j] = size
                total[i:j] = np.add.reduceat(np.log(own.probabilities(ngrams(s, at, own.order, own.width))), np.cumsum(size) - size)
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                cols = [pa.array(n, mask=null), pa.array(total, mask=null), pa.array(np.exp(-total / np.maximum(n, 1)), mask=null)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_symbols", "log_prob", "perplexity"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(narrow, score, "doc_id long, n_symbols long, log_prob double, perplexity double")


def perplexities(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) for every row of docs under a model of words counted over all of docs.

    A word that occurs once in all of docs is spelled in bytes, as is all that is between words but a single space.

    An empty text is scored by its end alone, a null text has null scores and isn't counted. A null doc_id is scored like
    another, rows that repeat one are counted and scored one by one. Whole texts are counted and scored. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    return scored(docs, fit(docs, order, WORDS))
