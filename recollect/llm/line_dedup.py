"""Removal of repeated lines through a join of deletion neighbourhoods (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.arrays import U, map_batches, mix
from recollect.plans.shared import discard, join_sized, stage, unused

#: Lines shorter than this many characters must be equal to count as repeated; 0: none.
MIN_FUZZY = 0
#: What stands in a line that isn't blank.
SOLID = "[^ \\t\\r\\f\\x0B]"
_B = 0xD6E8FEB86659FD93 | 1


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line that isn't blank. A document is known by doc_id and a hash of its text; nulls have none."""
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    lines = d.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(SOLID))


def _hashed(docs: DataFrame) -> DataFrame:
    return _lines(docs).select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), F.struct("doc_id", "th", "line_no").alias("at"), "line")


def _halves(line: str = "line") -> list:
    """Keys of which two lines at one edit share at least one: own length's first and last half, and those of a length less."""
    n = F.length(line)
    keys = []
    for size, less in ((n, 0), (n - 1, 1)):
        half = F.floor(size / 2).cast("int")
        keys.append(F.xxhash64(F.lit(0), size, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(1), size, F.substring(line, n - (size - half) + 1, size - half)))
    return keys


def variant_hashes(line: str) -> np.ndarray:
    """Hashes of what deleting each character of the line leaves, in order, and of the line itself, the last."""
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(U) + U(1)
    n = len(c)
    power = np.ones(n + 1, U)
    np.multiply.accumulate(np.full(n, _B, U), out=power[1:])
    sums = np.zeros(n + 1, U)
    np.cumsum(c * power[:n], out=sums[1:])
    # without character i: what precedes, and what follows moved down by one place
    left = sums[:n] + (sums[n] - sums[1:]) * U(pow(_B, -1, 1 << 64))
    return mix(np.append(left, sums[n:]))


def _earliest(batches):
    """Batches of (v, i, id), sorted, to (id, target): the smallest id of another line that meets it under v, if it is smaller.

    i is the place of the deleted character, -1 for a whole line. Lines meet if they lack the same character (then they
    differ in that one at most), or if one is what deleting a character of the other leaves.
    """

    def work(v, i, ids):
        run = np.ones(len(v), bool)
        run[1:] = (v[1:] != v[:-1]) | (i[1:] != i[:-1])
        start = np.flatnonzero(run)
        low = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(v))))
        group = np.ones(len(v), bool)
        group[1:] = v[1:] != v[:-1]
        start = np.flatnonzero(group)
        size = np.diff(np.append(start, len(v)))
        far = np.int64(1 << 62)
        whole = np.repeat(np.where(i[start] < 0, ids[start], far), size)
        cut = np.repeat(np.minimum.reduceat(np.where(i < 0, far, ids), start), size)
        target = np.where(i < 0, cut, np.minimum(low, whole))
        keep = target < ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(target[keep])], ["id", "target"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        part = [b.column(c).to_numpy() for c in range(3)]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield from work(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None:
        yield from work(*held)


def repeated_lines(docs: DataFrame, min_fuzzy: int = MIN_FUZZY, by_bytes: bool = False) -> DataFrame:
    """(doc_id, line_no, th, first_doc_id, first_line_no, edits): every line to remove, and the earliest line that it repeats.

    Places are ordered by doc_id, hash of the text, line number (from 0). Of equal lines the first stays. A distinct
    line whose first place lies after that of another line at edit distance 1 goes wherever it stands (edits 1); this isn't
    followed on from line to line: also a line that itself goes counts as the earlier one. Lines of fewer than min_fuzzy
    characters must be equal. Lines of nothing but white space, and rows with null doc_id or text, are left alone. Rows that
    repeat a doc_id and text are one document. An empty table has no repeated lines. Other columns are not read, whatever
    their names. An edit is one of a character or, by_bytes, of a byte of UTF-8, as DuckDB counts it: then "É" for "E" are two.

    Every line that shares a half with another is posted under the hashes of what deleting one character leaves, and
    under its own. What meets is reduced to its earliest line where it meets, so no pairs are formed; the edit distance to
    that line is verified.
    """
    lines = _hashed(docs)
    keys = F.when(F.length("line") >= min_fuzzy, F.array(*_halves()))
    distinct = lines.select("h", "g", "at", keys.alias("keys")).groupBy("h", "g").agg(F.min("at").alias("first"), F.min("at") != F.max("at"), F.first("keys").alias("keys"))
    distinct = stage(distinct.toDF("h", "g", "first", "again", "keys"), "lines")

    # lines at one edit share a half: only lines that share one with another line go on to the join of variants
    halves = distinct.where("keys is not null").select("h", "g", "first", F.explode(F.array_distinct("keys")).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = stage(halves.join(shared, "key", "left_semi").select("h", "g", "first").distinct(), "suspects")
    text = join_sized(_lines(docs), near.select("h", "g", "first.*"), ["doc_id", "th", "line_no"], "inner", 64)
    # a character for each byte; one edit of a byte is one of a character too, so halves lose none
    line = F.decode(F.encode("line", "UTF-8"), "ISO-8859-1").alias("line") if by_bytes else F.col("line")
    text = text.select("h", "g", F.struct("doc_id", "th", "line_no").alias("first"), line).dropDuplicates(["h", "g"])
    # range-partitioned and sorted by place, so that a smaller id is an earlier line
    text = stage(text.repartitionByRange("first").sortWithinPartitions("first").withColumn("id", F.monotonically_increasing_id()), "texts")

    def vary(batches):
        for b in batches:
            out = []
            for i, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = variant_hashes(line)
                out.append((v, np.append(np.arange(len(v) - 1, dtype=np.int32), np.int32(-1)), np.full(len(v), i)))
                if sum(len(x[0]) for x in out) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(t)) for x, t in zip(zip(*out), (np.int64, np.int32, np.int64))], ["v", "i", "id"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(t)) for x, t in zip(zip(*out), (np.int64, np.int32, np.int64))], ["v", "i", "id"])

    variants = map_batches(text.select("id", "line"), vary, "v long, i int, id long")
    met = map_batches(variants.repartition("v").sortWithinPartitions("v", "i"), _earliest, "id long, target long")
    met = stage(met.groupBy("id").agg(F.min("target").alias("target")), "met")
    other = text.select(F.col("id").alias("target"), F.col("first").alias("to"), F.col("line").alias("line2"))
    later = met.join(text.select("id", "h", "g", "line"), "id").join(other, "target").where(F.levenshtein("line", "line2", 1) == 1)
    later = stage(later.select("h", "g", F.col("to").alias("target")), "later")

    rule = distinct.where("again").select("h", "g", "first").join(later, ["h", "g"], "full").select("h", "g", F.coalesce("target", "first").alias("to"), F.col("target").isNotNull().cast("int").alias("edits"))
    rule = stage(rule, "rules")
    discard(distinct, near, text, met, later)
    gone = join_sized(lines.select("h", "g", "at"), rule, ["h", "g"], "inner", 72).where("edits = 1 or at != to")
    return gone.select("at.doc_id", "at.line_no", "at.th", F.col("to.doc_id").alias("first_doc_id"), F.col("to.line_no").alias("first_line_no"), "edits").distinct()


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the numbered lines; null where text is null."""

    def one(t, numbers):
        if t is None:
            return None
        out = {*numbers}
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)

    return pa.array([one(t.as_py(), n.as_py()) for t, n in zip(text, gone)], pa.string())


def drop_repeated_lines(docs: DataFrame, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_chars, where there is one, set to what is left.

    A document of which no line is left that isn't blank goes; all others stay, as do all that had no such line before.
    Rows with null doc_id or text are returned as they are; rows that repeat a doc_id and text are treated alike. All other
    columns are returned as they are, whatever their names. An empty table gives no rows.
    """
    i, t, lines = unused("doc", docs), unused("th", docs), unused("gone", docs)
    gone = repeated_lines(docs, min_fuzzy).groupBy(F.col("doc_id").alias(i), F.col("th").alias(t)).agg(F.collect_list("line_no").alias(lines))
    gone = stage(gone, "gone")
    d = join_sized(docs, gone, (docs["doc_id"] == gone[i]) & (F.xxhash64(docs["text"]) == gone[t]), "left", 80)
    # else the planner runs it twice in every task, for the filter and for what is left, in two workers
    left = _without.asNondeterministic()(F.when(F.col(lines).isNotNull(), F.col("text")), F.col(lines))
    d = d.withColumn("text", F.coalesce(left, "text")).where(F.col(lines).isNull() | F.col("text").rlike(SOLID))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return d.drop(i, t, lines)
