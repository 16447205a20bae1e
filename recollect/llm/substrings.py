"""Passages that several documents share, by a distributed suffix array (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrays import PLAIN, U, grams, map_batches, mix, pieces, span_hashes, words
from recollect.plans.shared import discard, fits, join_sized, stage

#: Words that a passage must have to count. Words are what stands between white space.
LENGTH = 50
#: Words by which suffixes are ordered, two to a key; of the words behind them equal hashes are equal.
LEADING = 6
KEYS = ("a", "b", "c", "rest")
#: Suffixes that one sorting task holds.
BUCKET = 1 << 20
_POS = (1 << 31) - 1


def _windows(data: np.ndarray, at: np.ndarray, length: int):
    """For the suffixes with `length` words or more: the hash of a run of words that equal beginnings have in common.

    That is the smallest hash of the runs of half the length within the first `length` words, so neighbouring suffixes
    mostly share it. Also: each document's first such suffix (one entry more), and hashes of all words and their offsets.
    """
    starts, ends, first = words(data, at, PLAIN)
    h = span_hashes(data, starts, ends)
    run = length // 2
    g, _ = grams(h, np.array([0, len(h)]), run)
    have = np.maximum(np.diff(first) - length + 1, 0)
    off = np.zeros(len(at), np.int64)
    np.cumsum(have, out=off[1:])
    pos = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], have)
    span = length - run + 1
    low, size = g, 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if len(low) and span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    return (low[pos] if off[-1] else np.zeros(0, U)), pos, off, h, first


def multikey_quicksort(columns: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """Order of rows by columns, the first first: ranges are split in three by a drawn pivot of one column, what equals it going on to the next column. All ranges of a round are split together."""
    keys, rng = np.stack(columns), np.random.default_rng(seed)
    order = np.arange(keys.shape[1])
    lo, hi, depth = np.array([0]), np.array([len(order)]), np.array([0])
    while True:
        use = (hi - lo > 1) & (depth < len(keys))
        lo, hi, depth = lo[use], hi[use], depth[use]
        if not len(lo):
            return order
        size = hi - lo
        begin = np.cumsum(size) - size
        row = np.arange(int(size.sum())) - np.repeat(begin - lo, size)
        own = order[row]
        v = keys[np.repeat(depth, size), own]
        pivot = np.repeat(keys[depth, order[lo + rng.integers(0, size)]], size)
        place, at, bounds = np.empty(len(row), np.int64), lo, [lo]
        for part in (v < pivot, v == pivot, v > pivot):
            n = np.add.reduceat(part.astype(np.int64), begin)
            seen = np.cumsum(part)
            shift = at - (seen[begin] - part[begin])  # what the ranges before hold is no place in this one
            place[part] = (seen - 1 + np.repeat(shift, size))[part]
            at = at + n
            bounds.append(at)
        order[place] = own
        lo, hi = np.concatenate(bounds[:3]), np.concatenate(bounds[1:])
        depth = np.concatenate([depth, depth + 1, depth])


def _suffixes(docs: DataFrame, length: int, bucket: int) -> DataFrame:
    """(doc_id, at, first_doc): suffixes whose first `length` words begin a suffix of another document too.

    at holds a hash of the text above the word's number, so that texts under one doc_id stay apart.
    """
    spark = docs.sparkSession

    def sketch(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, at in pieces(b.column(2)):
                low, _, off, _, _ = _windows(data, at, length)
                if len(low):
                    owner = np.repeat(ids[i:j], np.diff(off))
                    new = np.ones(len(low), bool)
                    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(owner[new])], ["run", "doc_id"])

    seen = map_batches(docs, sketch, "run long, doc_id long").groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    runs = stage(seen.where("low != high").select("run"), "runs")
    # equal beginnings of suffixes have a run in common, so only suffixes whose run is found in two documents need sorting
    few = fits(runs, 16)
    known = spark.sparkContext.broadcast(np.sort(runs.toPandas()["run"].to_numpy(np.int64)) if few else None)

    def emit(batches):
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, at in pieces(b.column(2)):
                low, pos, off, h, first = _windows(data, at, length)
                if not len(low):
                    continue
                doc = np.repeat(np.arange(j - i), np.diff(off))
                if few:
                    run = low.view(np.int64)
                    if not len(known.value):
                        continue
                    change = np.ones(len(run), bool)
                    change[1:] = run[1:] != run[:-1]
                    heads = run[change]
                    k = np.minimum(np.searchsorted(known.value, heads), len(known.value) - 1)
                    use = (known.value[k] == heads)[np.cumsum(change) - 1]
                    pos, doc, low = pos[use], doc[use], low[use]
                word = [h[pos + k] >> U(32) if k < length else np.zeros(len(pos), U) for k in range(LEADING)]
                keys = [word[k] << U(32) | word[k + 1] for k in range(0, LEADING, 2)]
                rest = length - LEADING
                keys.append(grams(h, np.array([0, len(h)]), rest)[0][pos + LEADING] if rest > 0 else np.zeros(len(pos), U))
                number = (tags[i:j][doc].astype(np.int64) & _POS) << 31 | (pos - first[:-1][doc])
                cols = [k.view(np.int64) for k in keys] + [ids[i:j][doc], number, low.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*KEYS, "doc_id", "at", "run"])

    suffixes = map_batches(docs, emit, "a long, b long, c long, rest long, doc_id long, at long, run long")
    if not few:
        suffixes = suffixes.join(runs, "run", "left_semi")
    return _sorted(stage(suffixes.drop("run"), "suffixes"), bucket)


def _sorted(suffixes: DataFrame, bucket: int) -> DataFrame:
    """Range-partition suffixes by their leading words, with splitters from a sample, sort each part, compare neighbours, and what meets at the borders of parts."""
    parts = max(1, -(-suffixes.count() // bucket))

    def compare(batches):
        cols = [np.concatenate(x) for x in zip(*([b.column(k).to_numpy() for k in range(6)] for b in batches))]
        if not cols:
            return
        order = multikey_quicksort(cols[:4])
        *keys, doc, at = (x[order] for x in cols)
        new = np.ones(len(doc), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        border = np.zeros(len(start), bool)
        border[[0, -1]] = parts > 1
        use = np.repeat((low != high) | border, size)
        out = [*keys, doc, at, np.repeat(low, size), np.repeat(high, size), np.repeat(border, size)]
        for i in range(0, len(doc), 1 << 16):
            keep = use[i : i + (1 << 16)]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)][keep]) for x in out], [*KEYS, "doc_id", "at", "low", "high", "border"])

    ranged = suffixes.repartitionByRange(parts, *KEYS, "doc_id", "at") if parts > 1 else suffixes.coalesce(1)
    found = stage(map_batches(ranged, compare, "a long, b long, c long, rest long, doc_id long, at long, low long, high long, border boolean"), "repeats")
    discard(suffixes)
    inner = found.where("not border").select("doc_id", "at", F.col("low").alias("first_doc"))
    border = found.where("border")
    met = stage(border.groupBy(*KEYS).agg(F.min("low").alias("first_doc"), F.max("high").alias("last")).where("first_doc != last"), "borders")
    return inner.unionByName(join_sized(border.select(*KEYS, "doc_id", "at"), met, list(KEYS), "inner", 56).select("doc_id", "at", "first_doc"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, start, stop, first_doc_id): runs of words start..stop-1 of doc_id of which every `length` consecutive ones stand in another document too.

    first_doc_id is the smallest doc_id of those that have a part of the run, which may be doc_id itself. All occurrences
    are returned, the first ones too; repeats within one document alone are none. Documents with equal texts are each
    one run, over the whole text. Words are separated by white space and control characters and compared as they are.
    Rows with null doc_id or text, and texts shorter than `length` words, have no run; rows that repeat doc_id and text
    are one document. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(3), "text").alias("y"), "text")
    groups = d.groupBy("x", "y").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("high"))
    copies = stage(groups.where("rep != high").select("x", "y", "rep"), "copied")
    # of equal texts one goes on, to be found in what other documents share with it
    marked = join_sized(d, copies, ["x", "y"], "left", 48)
    one = marked.where("rep is null or rep = doc_id").select("doc_id", F.col("x").alias("tag"), "text")
    shared = _suffixes(one, length, bucket)

    w = Window.partitionBy("doc_id").orderBy("at")
    runs = shared.withColumn("new", (F.col("at") - F.lag("at").over(w) > 1).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(w))
    runs = runs.groupBy("doc_id", "run").agg(F.min("at").alias("b"), F.max("at").alias("e"), F.min("first_doc").alias("first_doc_id"))
    runs = runs.select("doc_id", F.shiftright("b", 31).alias("tag"), (F.col("b").bitwiseAND(_POS)).cast("int").alias("start"), (F.col("e").bitwiseAND(_POS) + length).cast("int").alias("stop"), "first_doc_id")
    own = stage(copies.select(F.col("rep").alias("doc_id"), F.col("x").bitwiseAND(_POS).alias("tag")), "owners")
    runs = join_sized(runs, own, ["doc_id", "tag"], "left_anti", 32).drop("tag")

    def count(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int32)
            for i, j, data, at in pieces(b.column(2)):
                n[i:j] = np.diff(words(data, at, PLAIN)[2])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["doc_id", "rep", "n"])

    whole = map_batches(marked.where("rep is not null").select("doc_id", "rep", "text"), count, "doc_id long, rep long, n int").where(F.col("n") >= length).distinct()
    return runs.unionByName(whole.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("stop"), F.col("rep").alias("first_doc_id")))
