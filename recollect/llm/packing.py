"""Packing documents into training sequences by sum of squares (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrays import PLAIN, map_batches, pieces, words
from recollect.plans.shared import stage

#: Tokens of a sequence; tokens are words between white space, and one more ends each document.
CAPACITY = 2048
#: Tokens that one task packs. Tasks are independent; each leaves up to a few hundred sequences unfilled.
SHARD_TOKENS = 1 << 26

SCHEMA = "bin_id long, slot int, doc_id long, copy int, start long, n_tokens int"


def sum_of_squares(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each size (1..capacity) in turn its bin and the place in it; the number of bins.

    A size goes where the sum over gaps of the squared number of open bins with that gap becomes smallest, a new bin
    being one of the choices. Ties go to the smallest gap, a new bin last; of bins with one gap to the one that got it last.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is full and not counted, capacity is new
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, slots, held = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32), []
    far = np.int64(1) << 60
    for i, s in enumerate(sizes):
        here = count[s:capacity]
        gap = capacity
        if len(here):
            change = np.where(here > 0, 2 * (count[: capacity - s] - here) + 2, far)
            if here[0]:
                change[0] -= 1
            best = int(change.argmin())
            if change[best] <= (2 * count[capacity - s] + 1 if s < capacity else 0):
                gap = best + s
        if gap == capacity:
            b = len(held)
            held.append(0)
        else:
            b = at[gap].pop()
            count[gap] -= 1
        if gap > s:
            at[gap - s].append(b)
            count[gap - s] += 1
        bins[i], slots[i] = b, held[b]
        held[b] += 1
    return bins, slots, len(held)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n): tokens of every row with a word, with a hash of doc_id and text that sets the order."""

    def count(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for i, j, data, at in pieces(b.column(2)):
                n[i:j] = np.diff(words(data, at, PLAIN)[2])
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(n[some] + 1)], ["doc_id", "key", "n"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text").where("text is not null")
    return map_batches(narrow, count, "doc_id long, key long, n long")


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(bin_id, slot, doc_id, copy, start, n_tokens): every piece of every document and the sequence that holds it.

    A document has its words and one end token. What is longer than `capacity` is cut into full pieces, each a sequence
    of its own, and a remainder; remainders are placed by sum_of_squares in the order of a hash, so as they come.
    start counts tokens from the document's first. Null, empty and blank texts have no piece. A null doc_id is packed
    like another. Rows that repeat doc_id and text are packed one by one and numbered in `copy` from 0. Documents are
    spread over independent tasks by hash, so many that each has about shard_tokens. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    n = stage(lengths(docs), "lengths")
    total = n.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // shard_tokens) or 1

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("doc_id").fill_null(0).to_numpy()
        key, size, null = table.column("key").to_numpy(), table.column("n").to_numpy(), table.column("doc_id").is_null().to_numpy()
        order = np.lexsort((ids, key))
        ids, key, size, null = ids[order], key[order], size[order], null[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        copy = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        full, rest = size // capacity, size % capacity
        part = np.flatnonzero(rest)
        bins, slots, used = sum_of_squares(rest[part].tolist(), capacity)
        doc = np.repeat(np.arange(len(key)), full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        base = int(table.column("shard")[0].as_py()) << 40
        row = np.concatenate([part, doc])
        columns = [
            pa.array(base + np.concatenate([bins, used + np.arange(len(doc))])),
            pa.array(np.concatenate([slots, np.zeros(len(doc), np.int32)])),
            pa.array(ids[row], mask=null[row]),
            pa.array(copy[row].astype(np.int32)),
            pa.array(np.concatenate([full[part] * capacity, nth * capacity])),
            pa.array(np.concatenate([rest[part], np.full(len(doc), capacity)]).astype(np.int32)),
        ]
        return pa.Table.from_arrays(columns, ["bin_id", "slot", "doc_id", "copy", "start", "n_tokens"])

    return n.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(pack, SCHEMA)
