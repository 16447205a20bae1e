"""Lempel-Ziv phrase fingerprints and classes of documents with like phrases (operator 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrays import LETTERS, U, map_batches, mix, pieces, span_hashes
from recollect.llm.near_dedup import narrow, signed
from recollect.llm.signatures import classes

#: Production parameters: minimum hashes of a fingerprint, and how many must agree.
COORDINATES, LEAST = 64, 36
#: A phrase weighs its bytes, LONGEST at most, to this power: longer ones are rarer, and say more.
POWER, LONGEST = 5, 32
_TIMES, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every symbol, and each document's first (one entry more): runs of letters and digits; in scripts without spaces (from U+3000 on) every character."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = LETTERS[data]
    lead = (data < 128) | (data >= 192)
    alone = data >= 0xE3
    char = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))  # each byte's first one
    after = np.zeros(len(data), bool)  # what stands before is a character alone, or no letter
    after[1:] = ~inside[:-1] | alone[char[:-1]]
    after[at[:-1][at[:-1] < len(data)]] = True
    begins = inside & lead & (after | alone)
    starts = np.flatnonzero(begins)
    stops = np.append(begins | ~inside, True)  # where something else than the rest of a symbol stands
    stops[at] = True
    where = np.flatnonzero(stops)
    return starts, where[np.searchsorted(where, starts, "right")], np.searchsorted(starts, at)


def parse(symbols: list[int], sizes: list[int]) -> dict[int, int]:
    """The LZ78 phrases of a sequence of symbols, each the shortest piece that isn't a phrase yet: their 64-bit hashes, and the bytes of their symbols, of which sizes has the numbers.

    A last piece that is a phrase already adds none.
    """
    known: dict[int, int] = {}
    node = size = 0
    for s, n in zip(symbols, sizes):
        key = node ^ s
        size += n
        if key in known:
            node = key * _TIMES & _ALL
        else:
            known[key] = size
            node = size = 0
    return known


def weighted_minimum_hashes(h: np.ndarray, size: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """k minimum hashes of each document's set of phrases, as uint32: two sets agree in one with the probability that is their common share of weight.

    The least exponential variable of a rate that is the weight says which phrase is drawn; zeros where there is none.
    """
    weight = np.minimum(size, LONGEST).astype(np.float64) ** -POWER  # the inverse of it
    sig, full = np.zeros((len(off) - 1, k), np.uint32), np.flatnonzero(np.diff(off))
    if len(full):
        at = off[:-1][full]
        for j in range(k):
            u = mix(h ^ U((j + 1) * 0xD1342543DE82EF95 & _ALL))
            drawn = -np.log1p(-(u >> U(11)).astype(np.float64) / (1 << 53)) * weight
            sig[full, j] = mix(np.minimum.reduceat(drawn, at).view(U)) >> U(32)
    return sig


def fingerprints(docs: DataFrame, k: int = COORDINATES) -> DataFrame:
    """(doc_id, th, sig) for every row with a doc_id: a hash of its text (null for a null one), and k minimum hashes of the weighted set of its phrases, null without a word."""

    def sign(batches):
        for b in batches:
            for i, j, data, at in pieces(b.column(2)):
                starts, ends, first = symbols(data, at)
                h, size, found, sizes = span_hashes(data, starts, ends).tolist(), (ends - starts).tolist(), [], []
                off = np.zeros(j - i + 1, np.int64)
                for d in range(j - i):
                    own = parse(h[first[d] : first[d + 1]], size[first[d] : first[d + 1]])
                    found.extend(own)
                    sizes.extend(own.values())
                    off[d + 1] = len(found)
                yield signed(b.slice(i, j - i), weighted_minimum_hashes(np.array(found, U), np.array(sizes, np.int64), off, k), off)

    return map_batches(narrow(docs), sign, "doc_id long, th long, sig binary")


def similar_documents(docs: DataFrame, k: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, links), one row for every document: the smallest doc_id of the class that its links connect it with, and how many they are.

    Two documents are linked if their fingerprints agree in at least `least` of k minimum hashes. The share that agrees
    estimates the Jaccard similarity of the sets of phrases, weighted by their length, which follows how well one text helps to compress the other.
    Every document is compared with all; all links count, those of copies too, though none is written out; see
    signatures.classes. A document is a doc_id with a text: rows that repeat both are one, a doc_id with several texts has
    a row for each. Null, empty and wordless texts have no links and are a class of their own. Rows with null doc_id are
    left out. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    return classes(fingerprints(docs, k), k, least).select("doc_id", F.col("first.doc_id").alias("class_id"), "links")
