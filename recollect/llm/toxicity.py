"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.arrays import PIECE, PLAIN, pieces
from recollect.plans.shared import ship, stage

#: Lengths in bytes of the character n-grams of a word, white space before and after it included.
ORDERS = (3, 4, 5, 6)
BITS = 18
DIM = 8
#: A text is judged by its worst window of so many words; windows start at every STEP-th word.
WINDOW, STEP = 8, 4
#: Labelled documents of each class that training may use: the bound of the sample.
SAMPLE = 1200
#: Windows that training takes at once, at most; less than that a hundredth of all.
BATCH = 2048


def features(data: np.ndarray, bits: int = BITS):
    """For each order: (bucket of the n-gram that starts at each byte, whether it lies within one word and its two neighbours)."""
    inside = PLAIN[data]
    c = np.where(inside, data, 32).astype(np.uint32)
    h, ok = c * np.uint32(0x01000193), np.ones(len(c), bool)
    for n in range(2, ORDERS[-1] + 1):
        h = h[: max(len(c) - n + 1, 0)]
        h = (h + c[n - 1 :]) * np.uint32(0x01000193)
        ok = ok[: len(h)]
        if n > 2:
            ok = ok & inside[n - 2 : n - 2 + len(h)]
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), ok


def _starts(data: np.ndarray) -> np.ndarray:
    """The byte before each word; texts begin and end with a space."""
    inside = PLAIN[data]
    return np.flatnonzero(inside[1:] & ~inside[:-1])


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every window, and each document's first window (one entry more)."""
    starts = np.append(_starts(data), len(data))
    first = np.searchsorted(starts[:-1], at)
    have = -(-np.maximum(np.diff(first) - WINDOW, 0) // STEP) + (np.diff(first) > 0)
    off = np.zeros(len(at), np.int64)
    np.cumsum(have, out=off[1:])
    w = np.repeat(first[:-1] - off[:-1] * STEP, have) + np.arange(off[-1]) * STEP
    stop = np.minimum(w + WINDOW, np.repeat(first[1:], have))
    return starts[w], np.where(stop == np.repeat(first[1:], have), np.repeat(at[1:], have), starts[stop]), off


@dataclass
class Model:
    """Embeddings of the buckets, the softmax layer, and the least log-odds of a toxic window."""

    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    cut: float = 0.0

    def table(self) -> np.ndarray:
        """What each bucket adds to the log-odds of toxic: averaging and the linear layer commute."""
        return (self.embedding @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)


def window_odds(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of toxic for each window of bytes."""
    total, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1, np.int32)
    for bucket, ok in features(data):
        total[1 : len(ok) + 1] += table[bucket] * ok
        count[1 : len(ok) + 1] += ok
    np.cumsum(total, out=total)
    np.cumsum(count, out=count)
    # an n-gram counts where it starts; those that begin at a window's last word may end behind it, at a space
    return (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1) + bias


def document_odds(data: np.ndarray, at: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Each document's largest window odds; -inf without a word."""
    begin, end, off = windows(data, at)
    odds = np.full(len(at) - 1, -np.inf)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        odds[some] = np.maximum.reduceat(window_odds(data, begin, end, table, bias), off[:-1][some])
    return odds


def _all_odds(data: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    """The log-odds of all windows, worked out for about PIECE bytes at a time."""
    out, i = [], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        own = data[at[i] : at[j]]
        begin, end, _ = windows(own, at[i : j + 1] - at[i])
        out.append(window_odds(own, begin, end, model.table(), float(model.bias[1] - model.bias[0])))
        i = j
    return np.concatenate(out)


def train(texts: list[str], toxic: np.ndarray, seed: int = 7, rounds: int = 3) -> Model:
    """Fit to documents labelled as a whole, on all of their windows.

    Each document has a weight of its own, spread over its windows: in the first round evenly; in later ones in proportion
    to what they look like so far, exp(log-odds), for a toxic document, and for others half so and half evenly. Classes
    weigh the same. Embeddings and softmax move together, by Adagrad. Texts are lower-cased. The cut is set on a quarter
    of the documents that isn't trained on, halfway between the classes where errors are fewest. One class alone, or none,
    gives a model that finds nothing toxic.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32), np.inf)
    toxic = np.asarray(toxic, bool)
    raw = [f" {t.lower()} ".encode() for t in texts]
    if not len(raw) or toxic.all() or not toxic.any():
        return model
    held = rng.random(len(raw)) < 0.25
    rows = np.flatnonzero(~held)
    data = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(raw[i]) for i in rows])])
    begin, end, off = windows(data, at)
    label = toxic[rows]
    squares = [np.full(1 << BITS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)]
    owner_of = np.repeat(np.arange(len(rows)), np.diff(off))
    some = off[:-1][np.diff(off) > 0]
    even = 1 / np.diff(off)[owner_of]
    step = min(BATCH, max(64, len(begin) // 100))
    touched, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    for r in range(rounds):
        weight = even
        if r:
            odds = _all_odds(data, at, model)
            top = np.zeros(len(rows))
            top[np.diff(off) > 0] = np.maximum.reduceat(odds, some)
            seen = np.exp(odds - top[owner_of])
            seen /= np.bincount(owner_of, seen, len(rows))[owner_of]
            weight = np.where(label[owner_of], seen, (seen + even) / 2)
        y_all = label[owner_of]
        weight = weight * np.where(y_all, 0.5 / max(weight[y_all].sum(), 1e-9), 0.5 / max(weight[~y_all].sum(), 1e-9)) * len(weight)
        chosen = rng.permutation(len(weight))
        for i in range(0, len(chosen), step):
            w = chosen[i : i + step]
            y = y_all[w]
            f, owner = _bags_of(data, begin[w], end[w])
            n = np.maximum(np.bincount(owner, minlength=len(w)), 1).astype(np.float32)
            touched[f] = True
            own = np.flatnonzero(touched)  # the buckets of this batch: no other has a gradient
            touched[own] = False
            place[own] = np.arange(len(own))
            at_own, e = place[f], model.embedding[own].T.astype(np.float64)
            hidden = np.stack([np.bincount(owner, x[at_own], len(w)) for x in e], 1).astype(np.float32) / n[:, None]
            z = hidden @ model.weight + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(w)), y.astype(int)] -= 1
            g *= (weight[w] / len(w))[:, None]
            g_hidden = (g @ model.weight.T) if np.abs(model.weight).max() > 0 else np.zeros_like(hidden)
            for part, grad, square in ((model.weight, hidden.T @ g, squares[1]), (model.bias, g.sum(0), squares[2])):
                square += (grad**2).astype(np.float32)
                part -= (0.1 * grad / np.sqrt(square)).astype(np.float32)
            per = np.ascontiguousarray((g_hidden / n[:, None]).T, np.float64)
            grad = np.stack([np.bincount(at_own, x[owner], len(own)) for x in per], 1)
            squares[0][own] += (grad**2).mean(1).astype(np.float32)
            model.embedding[own] -= (0.1 * grad / np.sqrt(squares[0][own])[:, None]).astype(np.float32)
    rest = np.flatnonzero(held)
    if toxic[rest].all() or not toxic[rest].any():
        rest = np.arange(len(raw))
    data = np.frombuffer(b"".join(raw[i] for i in rest), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(raw[i]) for i in rest])])
    per_window, off = _all_odds(data, at, model), windows(data, at)[2]
    odds = np.full(len(at) - 1, -np.inf)
    some = np.flatnonzero(np.diff(off))
    odds[some] = np.maximum.reduceat(per_window, off[:-1][some])
    order = np.argsort(odds)
    odds, y = odds[order], toxic[rest][order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(~y[::-1])])[::-1]  # cut before the i-th
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[odds[np.isfinite(odds)][0] - 1 if np.isfinite(odds).any() else 0], odds, [odds[-1] + 1]])
    i = best[len(best) // 2]
    low, high = edges[i], edges[i + 1]
    model.cut = float((low + high) / 2) if np.isfinite(low) else float(high)
    return model


def _bags_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of some windows, by cutting them out with what their last n-grams reach into."""
    reach = ORDERS[-1]
    size = end - begin
    pad = np.minimum(end + reach, len(data)) - begin
    gap = size + reach + 1
    base = np.cumsum(gap) - gap
    out = np.full(int(gap.sum()), 32, np.uint8)
    pos = np.arange(int(pad.sum())) - np.repeat(np.cumsum(pad) - pad, pad)
    out[np.repeat(base, pad) + pos] = data[np.repeat(begin, pad) + pos]
    window = np.repeat(np.arange(len(begin)), gap)
    own = np.zeros(len(out), bool)
    mine = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    own[np.repeat(base, size) + mine] = True
    fs, ws = [], []
    for bucket, ok in features(out):
        take = ok & own[: len(ok)]
        fs.append(bucket[take])
        ws.append(window[: len(ok)][take])
    return np.concatenate(fs), np.concatenate(ws)


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of up to `limit` labelled documents of each class, first by a hash of doc_id and label. A doc_id with several texts gives one of them; one with both labels is in both classes."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).alias("y")).distinct()
    known = stage(known, "labels")
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(limit) for y in (False, True)]
    picked = stage(picks[0].unionByName(picks[1]), "picked")  # at most 2 * limit rows, so it may be broadcast
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id")
    # one text for each, whatever their number, so no more rows come to the driver
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("id", "y").collect()
    return [r.text for r in rows], np.array([r.y for r in rows], bool)


def _low(text: str) -> F.Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))


def _odds(spark: SparkSession, model: Model):
    """A function of lower-cased texts: the log-odds of the worst window above the cut, null without a word."""
    shipped = spark.sparkContext.broadcast((model.table(), float(model.bias[1] - model.bias[0]), model.cut))
    ship(spark)

    @F.arrow_udf("double")
    def odds(text: pa.Array) -> pa.Array:
        table, bias, cut = shipped.value
        out = np.full(len(text), -np.inf)
        for i, j, data, at in pieces(text):
            out[i:j] = document_odds(data, at, table, bias)
        out = out - cut if np.isfinite(cut) else np.where(np.isfinite(out), -1e9, out)
        return pa.array(out, mask=~np.isfinite(out))

    return odds


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and `odds`, the log-odds of the worst window above the cut: toxic from 0. Null without a word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _odds(docs.sparkSession, model)(_low("text")).alias("odds"))


def toxic_documents(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, odds, toxic) for every row of docs, after training on labels joined with docs.

    Training sees at most `limit` labelled documents of each class; every document is scored over its whole text, by its
    worst window of WINDOW words. Null, empty and blank texts have null odds and aren't toxic. A null doc_id is scored
    like another; rows that repeat one are scored one by one. No labels, or of one class only: nothing is toxic. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    model = train(*sample(docs, labels, limit))
    return scored(docs, model).withColumn("toxic", F.coalesce(F.col("odds") >= 0, F.lit(False)).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """docs without the rows whose worst window is toxic; all other rows and all columns as they are, whatever their names.

    Rows are judged one by one, by text alone, so repeated rows go or stay together. Rows with a null, empty or blank text
    stay. A doc_id that is labelled both ways trains both classes. Without labels of both classes all rows stay; an empty
    table gives no rows.
    """
    model = train(*sample(docs, labels, limit))
    return docs.where(F.coalesce(_odds(docs.sparkSession, model)(_low("text")) < 0, F.lit(True)))
