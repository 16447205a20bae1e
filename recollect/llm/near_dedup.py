"""MinHash near-duplicate removal by a signature-coordinate inverted join (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrays import LETTERS, binary, grams, map_batches, minimum_hashes, pieces, span_hashes, words
from recollect.llm.signatures import classes
from recollect.plans.shared import join_sized, stage, unused

#: Production parameters: words a shingle, coordinates of a signature, coordinates that must agree.
SHINGLE, COORDINATES, LEAST = 3, 64, 38


def signatures(docs: DataFrame, shingle: int = SHINGLE, k: int = COORDINATES) -> DataFrame:
    """(doc_id, th, sig) for every row with a doc_id: a hash of its text (null for a null one), and its signature, null where no word is.

    Words are lower-cased runs of letters and digits; a shorter text is one shingle.
    """

    def sign(batches):
        for b in batches:
            for i, j, data, at in pieces(b.column(2)):
                starts, ends, first = words(data, at, LETTERS)
                g, off = grams(span_hashes(data, starts, ends), first, shingle, short=True)
                yield signed(b.slice(i, j - i), minimum_hashes(g, off, k), off)

    return map_batches(narrow(docs), sign, "doc_id long, th long, sig binary")


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): what is signed; th is a hash of the text, text is lower-cased."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("th"), F.lower("text").alias("text"))


def signed(rows: pa.RecordBatch, sig: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """rows' first two columns and their signatures; null where off says that there is nothing signed."""
    none = np.diff(off) == 0
    sig = binary(sig)
    if none.any():
        sig = sig.take(pa.array(np.arange(len(none)), mask=none))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), sig], ["doc_id", "th", "sig"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, k: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, links), one row for every document: the smallest doc_id of the class that its links connect it with, and how many they are.

    Two documents are linked if their MinHash signatures agree in at least `least` of k coordinates; copies are linked
    like others, and all links count, though none is written out; see signatures.classes. A document is a doc_id with a
    text: rows that repeat both are one, a doc_id with several texts has a row for each. Null, empty and wordless texts
    have no links and are a class of their own. Rows with null doc_id are left out. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    return classes(signatures(docs, shingle, k), k, least).select("doc_id", F.col("first.doc_id").alias("class_id"), "links")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, k: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """The rows of docs without near duplicates: of each class the document with the smallest doc_id stays (of those of one doc_id, that with the smallest hash of its text).

    A document is a doc_id with a text, so a doc_id's other texts stay where they are no near duplicates. Rows that
    repeat doc_id and text are reduced to one, any of them. Rows with null doc_id, or a text that is null or without a
    word, all stay. All columns are returned as they are, whatever their names; an empty table gives no rows.
    """
    sigs = signatures(docs, shingle, k)
    every = stage(classes(sigs, k, least).where("signed"), "classified")
    gone = stage(every.where("first.doc_id != doc_id or first.th != th").select("doc_id", "th"), "gone")
    text = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    i, t = unused("doc", docs), unused("th", docs)

    def matched(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return join_sized(df, keys.toDF(i, t), (df["doc_id"] == F.col(i)) & (text == F.col(t)), how, 32)

    kept = matched(docs, gone, "left_anti")
    words_in = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).agg(F.count("*").alias("n")).where("n > 1")
    again = stage(words_in.join(every.select("doc_id", "th"), ["doc_id", "th"], "left_semi").select("doc_id", "th"), "again")
    if again.isEmpty():
        return kept
    return matched(kept, again, "left_anti").unionByName(matched(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))
