"""With how many others each document's signature agrees in enough coordinates, and the classes this makes; by an inverted join that misses none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrays import U, map_batches, mix
from recollect.plans.shared import discard, join_sized, stage

#: Size of the sketch of how many documents have a coordinate-value pair. It orders the pairs; any order is right, a closer one is faster.
SKETCH = 1 << 18
#: Elements of the prefix that two documents have in common at least, if they agree in enough coordinates.
EXTRA = 4
#: Posting lists of up to SHORT documents give pairs, of which the meetings are counted. The documents of a longer list are compared in blocks of about BLOCK, each two blocks in a piece of their own.
SHORT, BLOCK = 64, 4096
#: Pairs compared at once.
PAIRS = 1 << 15


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, k), np.uint32)
    at = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint32, len(column) * k, at).reshape(-1, k)


def _elements(sig: np.ndarray) -> np.ndarray:
    """One 64-bit number for each coordinate-value pair."""
    return mix((np.arange(sig.shape[1], dtype=U) << U(32)) | sig.astype(U))


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the links a-b connect it with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def compare_lists(k: int, least: int, block_pairs: int = PAIRS):
    """Batches of (element, lo, hi, side, g, before, short, n, sig), sorted by element, lo, hi and side, to (g, links, root).

    Rows of one (element, lo, hi) are compared: all with one another where lo = hi, else those of side 0 with those of
    side 1. A pair counts at the first of the elements that both are posted under (before: the coordinates of those that
    precede, as bits), unless one of these has a short list (short: their coordinates), and only if `least` coordinates
    agree. links: documents that g agrees with; root: the smallest g that the batch connects it with.
    """

    def work(lo, hi, side, g, before, short, n, sig, new):
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        end = np.repeat(start + size, size)
        own = lo == hi
        ones = np.add.reduceat(side, start)
        begin = np.where(own, np.arange(len(new)) + 1, end - np.repeat(ones, size))
        count = np.where(own | (side == 0), end - begin, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        ids, node = np.unique(g, return_inverse=True)
        links, pairs = np.zeros(len(ids), np.int64), []
        i0 = 0
        while i0 < len(new):
            i1 = max(i0 + 1, int(np.searchsorted(total, total[i0] + block_pairs, "right")) - 1)
            i = np.repeat(np.arange(i0, i1), count[i0:i1])
            j = np.arange(total[i1] - total[i0]) - np.repeat(total[i0:i1] - total[i0] - begin[i0:i1], count[i0:i1])
            i0 = i1
            if not len(i):
                continue
            bits = np.packbits(sig[i] == sig[j], axis=1, bitorder="little")
            bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 8 - bits.shape[1])))).view("<u8")[:, 0]
            ok = (np.bitwise_count(bits) >= least) & ((bits & (before[i] | (short[i] & short[j]))) == 0)
            if ok.any():
                a, b = i[ok], j[ok]
                links += np.bincount(node[a], n[b], len(ids)).astype(np.int64) + np.bincount(node[b], n[a], len(ids)).astype(np.int64)
                pairs.append(np.unique(np.stack([node[a], node[b]]), axis=1))
        if pairs:
            a, b = np.concatenate(pairs, 1)
            some, low = np.flatnonzero(links), _connected(len(ids), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[low[some]])], ["g", "links", "root"])

    def rows(x, new):
        return work(x[1], x[2], x[3].astype(np.int64), x[4], x[5].view(U), x[6].view(U), x[7], x[8], new)

    return in_groups(lambda b: [b.column(c).to_numpy() for c in range(8)] + [_matrix(b.column(8), k)], 3, rows)


def in_groups(columns, keys: int, work):
    """A function of batches that hands whole groups of rows to work(arrays, where a group begins). columns: a batch's arrays, of which the first `keys` say what a group is; rows come sorted by these."""

    def begins(x):
        new = np.ones(len(x[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in x[:keys]])
        return new

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                part = columns(b)
                held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
                new = begins(held)
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield from work([x[:last] for x in held], new[:last])
                    held = [x[last:] for x in held]
        if held is not None:
            yield from work(held, begins(held))

    return run


def _pairs_of(x, new):
    """(element, g, several) of short lists to (a, b, met, several): the pairs of each list, those of a batch added up."""
    start = np.flatnonzero(new)
    end = np.repeat(np.append(start[1:], len(new)), np.diff(np.append(start, len(new))))
    count = end - np.arange(len(new)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    i = np.repeat(np.arange(len(new)), count)
    j = np.arange(total[-1]) - np.repeat(total[:-1] - np.arange(len(new)) - 1, count)
    a, b, several = np.minimum(x[1][i], x[1][j]), np.maximum(x[1][i], x[1][j]), np.minimum(x[2][i], x[2][j])
    order = np.lexsort((b, a))
    a, b, several = a[order], b[order], several[order]
    one = np.ones(len(a), bool)
    one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(one)
    yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(np.diff(np.append(at, len(a))).astype(np.int32)), pa.array(several[at])], ["a", "b", "met", "several"])


def classes(sigs: DataFrame, k: int, least: int, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, signed, first, links), one row for each different (doc_id, th): its class and its links.

    sigs: (doc_id, th, sig), th a hash of the text, sig holding k uint32 (64 at most) or null. Two documents are linked
    if at least `least` coordinates agree; links counts them all, copies too; a class is what links connect, and first
    the smallest (doc_id, th) in it. Documents without a signature (signed false) have none and stand alone.

    Documents with one and the same signature are one group, so copies cost nothing more. Each group is posted under its
    k - least + EXTRA rarest coordinate-value pairs (prefix): two that agree in `least` coordinates share EXTRA of these.
    Collisions are counted for pairs that meet in a short list; those that can't come to EXTRA are skipped unmerged, the
    others compared in full. Groups that meet in long lists alone, in EXTRA of them, are compared there in blocks, a pair
    at the first list that both are in; there counts and connections are added up within tasks, and no pair is written or
    shuffled. Nothing is capped and no link is lost. n groups in one long list cost n * n / 2 comparisons of signatures.
    """
    if k > 64:
        raise ValueError("a signature has 64 coordinates at most")
    spark = sigs.sparkSession
    signed = F.col("sig").isNotNull()
    keyed = stage(sigs.withColumns({"x": F.when(signed, F.xxhash64("sig")), "y": F.when(signed, F.xxhash64(F.lit(1), "sig"))}), "signatures")
    members = stage(keyed.select("doc_id", "th", "x", "y").distinct(), "members")
    count = members.where("x is not null").groupBy("x", "y").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("n"))
    one = keyed.where("x is not null").groupBy("x", "y").agg(F.first("sig").alias("sig"))
    groups = stage(count.join(one, ["x", "y"]).withColumn("g", F.monotonically_increasing_id()), "groups")
    discard(keyed)
    reps = groups.select("g", "sig")

    def tally(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                total += np.bincount((_elements(_matrix(b.column(0).slice(i, 4096), k)) & U(SKETCH - 1)).astype(np.int64).ravel(), minlength=SKETCH)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    often = np.zeros(SKETCH, np.int64)
    for r in map_batches(reps.select("sig"), tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        often[r.bucket] = r.n
    often = spark.sparkContext.broadcast(often)
    extra = min(EXTRA, least)
    prefix = k - least + extra

    def post(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                c = b.slice(i, 4096)
                e = _elements(_matrix(c.column(1), k))
                # by the sketch's count, then by the element itself: the same order for every document
                chosen = np.lexsort((e, often.value[(e & U(SKETCH - 1)).astype(np.int64)]), axis=1)[:, :prefix]
                bit = U(1) << chosen.astype(U)
                before = np.cumsum(bit, axis=1) - bit
                ids = np.repeat(c.column(0).to_numpy(zero_copy_only=False), prefix)
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(e, chosen, 1).ravel().view(np.int64)), pa.array(ids), pa.array(before.ravel().view(np.int64)), pa.array(bit.ravel().view(np.int64))], ["element", "g", "before", "bit"])

    posts = map_batches(reps, post, "element long, g long, before long, bit long")
    sizes = posts.groupBy("element").agg(F.count("*").alias("size")).where("size > 1")
    met = stage(posts.join(sizes, "element"), "postings")
    is_long = F.col("size") > short
    masks = met.groupBy("g").agg(F.bit_or(F.when(is_long, F.col("bit"))).alias("long"), F.bit_or(F.when(~is_long, F.col("bit"))).alias("short")).where("long is not null")
    masks = stage(masks.select("g", F.bit_count("long").alias("several"), F.coalesce("short", F.lit(0)).cast("long").alias("short")), "masks")

    near = join_sized(met.where(~is_long).select("element", "g"), masks.select("g", "several"), "g", "left", 24)
    near = near.select("element", "g", F.coalesce("several", F.lit(0)).cast("int").alias("several")).repartition("element").sortWithinPartitions("element")
    pairs = map_batches(near, in_groups(lambda b: [b.column(c).to_numpy() for c in range(3)], 1, _pairs_of), "a long, b long, met int, several int")
    pairs = stage(pairs.groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("several").alias("several")).where(F.col("met") + F.col("several") >= extra).select("a", "b"), "pairs")
    some = stage(pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct(), "paired")
    known = stage(join_sized(groups.select("g", "n", "sig"), some, "g", "left_semi", 16), "paired-signatures")
    both = join_sized(pairs, known.toDF("a", "na", "sa"), "a", "inner", 300)
    both = join_sized(both, known.toDF("b", "nb", "sb"), "b", "inner", 300)

    def compare(batches):
        for b in batches:
            ok = pa.array((_matrix(b.column(4), k) == _matrix(b.column(5), k)).sum(1) >= least)
            yield b.select(["a", "b", "na", "nb"]).filter(ok)

    alike = map_batches(both.select("a", "b", "na", "nb", "sa", "sb"), compare, "a long, b long, na long, nb long")
    alike = alike.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("nb").alias("links")), F.struct(F.col("b").alias("g"), F.col("na").alias("links")))).alias("x"), F.col("a").alias("root"))
    alike = alike.select("x.g", "x.links", "root")

    blocks = F.ceil(F.col("size") / block).cast("int")
    far = met.where(is_long).join(masks.where(F.col("several") >= extra), "g").join(groups.select("g", "n", "sig"), "g")
    far = far.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("g"), blocks).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    far = far.select("element", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "g", "before", "short", "n", "sig")
    far = far.repartition("element", "lo", "hi").sortWithinPartitions("element", "lo", "hi", "side")
    found = stage(alike.unionByName(map_batches(far, compare_lists(k, least), "g long, links long, root long")), "links")
    discard(met, masks, pairs, some, known)

    roots = stage(components(found.select(F.col("g").alias("doc_a"), F.col("root").alias("doc_b"))), "roots")
    linked = join_sized(found.groupBy("g").agg(F.sum("links").alias("links")), roots.toDF("g", "root"), "g", "left", 32)
    linked = groups.drop("sig").join(linked, "g", "left").where("links is not null or n > 1").withColumn("root", F.coalesce("root", "g"))
    linked = stage(linked, "linked")
    least_of = stage(linked.groupBy("root").agg(F.min("first").alias("first")), "classes")
    of = join_sized(linked.drop("first"), least_of, "root", "inner", 40).select("x", "y", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    of = stage(of, "known")
    every = join_sized(members, of, ["x", "y"], "left", 56)
    return every.select("doc_id", "th", F.col("x").isNotNull().alias("signed"), F.coalesce("first", F.struct("doc_id", "th")).alias("first"), F.coalesce("links", F.lit(0)).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, root) for every document in a pair (doc_a, doc_b) that isn't its own root; root is the smallest doc_id that it is connected with.

    Alternating large-star and small-star rounds, each written to the shared folder in place of the last, until nothing changes.
    """
    e = pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct()
    e = stage(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, stage(small.where("u != v").distinct(), "edges")
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        seen = now
