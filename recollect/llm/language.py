"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrays import code_points, map_batches, pieces
from recollect.plans.shared import join_sized, stage

#: Lengths of the n-grams, over the characters of the lower-cased text with a space before and after it.
ORDERS = (2, 3, 4)
BITS = 16
#: Labelled documents of each language that training may use: the bound of the sample; and languages at most, of which the matrix is sent to all workers.
SAMPLE, LANGUAGES = 1500, 400


def features(data: np.ndarray, at: np.ndarray):
    """For each order: the buckets of all n-grams of characters within documents, and where each document's begin (one entry more)."""
    c, at = code_points(data, at)
    h = c * np.uint32(0x01000193)
    length = np.diff(at)
    for n in range(2, ORDERS[-1] + 1):
        h = (h[: max(len(c) - n + 1, 0)] + c[n - 1 :]) * np.uint32(0x01000193)
        if n in ORDERS:
            bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            have = np.maximum(length - n + 1, 0)
            off = np.zeros(len(at), np.int64)
            np.cumsum(have, out=off[1:])
            if len(length) > 1:
                inside = np.ones(len(bucket), bool)
                for over in range(1, n):  # n-grams that begin in the last n - 1 bytes reach into the next document
                    past = at[1:] - over
                    inside[past[(length >= over) & (past < len(bucket))]] = False
                bucket = bucket[inside]
            yield bucket, off


def _text() -> F.Column:
    return F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("text")


def sample(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(lang, text) of up to `limit` labelled documents of each language, first by a hash of doc_id and text."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = stage(known.groupBy("lang").count(), "languages")
    if (n := sizes.count()) > LANGUAGES:
        raise ValueError(f"lang has {n} values, more than the {LANGUAGES} that a matrix is made for")
    # a hash below this holds twice what is wanted, so that the rows to be ranked don't grow with the table
    least = F.lit(-float(1 << 63)) + F.least(F.lit(1.0), F.lit(2.0 * limit + 100) / F.col("count")) * float(2**64 - 2048)
    near = join_sized(known, sizes, "lang", "inner", 64).where(F.col("h") <= least)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("__n", place).where(F.col("__n") <= limit).select("lang", _text())


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log-probabilities, buckets by languages, with add-one smoothing and without priors."""

    def tally(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).dictionary_encode()
            code, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for i, j, data, at in pieces(b.column(1)):
                here, own = np.unique(code[i:j], return_inverse=True)
                for bucket, off in features(data, at):
                    n = np.bincount(np.repeat(own, np.diff(off)) << BITS | bucket, minlength=len(here) << BITS).reshape(len(here), -1)
                    for k, c in enumerate(here):
                        counts[names[c]] = counts.get(names[c], 0) + n[k]
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])

    found = map_batches(labelled, tally, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.ones((1 << BITS, len(langs)), np.float32 if len(langs) > 64 else np.float64)
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] += found["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, language, margin) for every row: the likeliest language and by how much it leads the next, per n-gram."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        langs, matrix = shipped.value
        columns = [np.ascontiguousarray(matrix[:, k]) for k in range(len(langs))]
        for b in batches:
            best, margin = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            for i, j, data, at in pieces(b.column(1)) if langs else ():
                total, n = np.zeros((j - i, len(langs))), np.zeros(j - i)
                for bucket, off in features(data, at):
                    some = np.flatnonzero(np.diff(off))
                    n += np.diff(off)
                    for k, column in enumerate(columns):
                        if len(some):
                            total[some, k] += np.add.reduceat(column[bucket], off[:-1][some], dtype=np.float64)
                best[i:j] = np.where(n > 0, total.argmax(1), -1)
                if len(langs) > 1:
                    top = np.sort(total, axis=1)
                    margin[i:j] = (top[:, -1] - top[:, -2]) / np.maximum(n, 1)
            none = best < 0
            names = pa.array(langs + [""] if not langs else langs).take(pa.array(np.maximum(best, 0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.to_pylist(), pa.string(), mask=none), pa.array(margin, mask=none)], ["doc_id", "language", "margin"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\S"), _text()).alias("text"))
    return map_batches(narrow, score, "doc_id long, language string, margin double")


def languages(docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, language, margin) for every row of docs, after training on the lang column of up to `limit` documents of each language.

    Every document is scored over its whole text. Ties go to the language first in the alphabet. Null, empty and blank
    texts have null language, as has every row when no row has both lang and text. A null doc_id is scored like another,
    rows that repeat one are scored one by one. An empty table gives no rows. Other columns are not read.
    """
    return identified(docs, train(sample(docs, limit)))
