"""Consistent hashing: the ring, where memories belong, what moves, and searches over shards."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators import recall
from recollect.plans.shared import stage

POINTS = 100
_DIGITS = 3


def ring(shards: list[str], replicas: int = 1) -> list[tuple[str, str]]:
    """(point, shard) in order: POINTS * replicas points for each shard, MD5 of shard:number."""
    return sorted((hashlib.md5(f"{s}:{i}".encode()).hexdigest(), s) for s in shards for i in range(POINTS * replicas))


def hashed(key: Column) -> Column:
    return F.md5(key.cast("string"))


def assign(df: DataFrame, key: str, shards: list[str], name: str = "shard", replicas: int = 1) -> DataFrame:
    """df with the shard of each key: that of the first point not before the key's hash, round the ring.

    Leading digits of the hash find the few points it can meet, so this is a join on equality with a table of fixed
    size (4096 rows), not a comparison with every point.
    """
    points = ring(shards, replicas)
    if not points:
        return df.withColumn(name, F.lit(None).cast("string"))
    spark: SparkSession = df.sparkSession
    hashes, rows = [p for p, _ in points], []
    for k in range(16**_DIGITS):
        low = f"{k:0{_DIGITS}x}"
        i, j = bisect_left(hashes, low), bisect_left(hashes, low + "g")
        rows.append((low, [*points[i:j], ("g", points[j % len(points)][1])]))
    table = spark.createDataFrame(rows, "__low string, __points array<struct<p:string,s:string>>")
    h = hashed(F.col(key))
    found = df.withColumns({"__h": h, "__low": F.substring(h, 1, _DIGITS)}).join(F.broadcast(table), "__low")
    first = F.filter("__points", lambda x: x["p"] >= F.col("__h"))[0]["s"]
    return found.withColumn(name, first).select(*df.columns, name)


def moves(df: DataFrame, key: str, old: list[str], new: list[str]) -> DataFrame:
    """(key, old, new) for what belongs elsewhere after shards were added or removed."""
    return assign(assign(df.select(key), key, old, "old"), key, new, "new").where("old != new")


def statistics(memories: DataFrame, shards: list[str], active: float = 0.01) -> DataFrame:
    """(shard, n, active, mean_activation) for each shard."""
    own = assign(memories.select("id", "activation"), "id", shards)
    return own.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("activation") > active).alias("active"), F.avg("activation").alias("mean_activation"))


def search_tags(memories: DataFrame, tags: list[str], shards: list[str], limit: int) -> DataFrame:
    """Memories with all tags known to their shard: each shard's 2 * limit most active, then the most active of these."""
    want = sorted({t.lower() for t in tags})
    own = F.transform("tags", F.lower)
    m = assign(memories, "id", shards)
    known = m.groupBy("shard").agg(*[F.bool_or(F.array_contains(own, t)).alias(f"__k{i}") for i, t in enumerate(want)])  # a row for each shard
    met, some = F.lit(True), F.lit(False)
    for i, t in enumerate(want):
        met, some = met & (~F.col(f"__k{i}") | F.array_contains(own, t)), some | F.col(f"__k{i}")
    found = m.join(F.broadcast(known), "shard").where(met & some).select(*memories.columns, "shard")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("activation"), "id"))
    return recall.top(found.withColumn("__place", place).where(F.col("__place") <= 2 * limit).drop("__place"), "activation", limit)


def _words(text: str) -> list[str]:
    return re.findall(r"\b\w+\b", text.lower())


def search_words(memories: DataFrame, text: str, shards: list[str], limit: int) -> DataFrame:
    """(id, shard, a): the share of the query's words, in proportion to the best of the shard; each shard's 2 * limit best, then the best."""
    m = stage(assign(recall.word_hits(memories, _words(text)), "id", shards), "hits")
    best = m.groupBy("shard").agg(F.max("n").alias("best"))  # a row for each shard
    return _best(m.join(F.broadcast(best), "shard").select("id", "shard", F.round(F.col("n") / F.col("best"), recall.DIGITS).alias("a")), limit)


def _best(m: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("a"), "id"))
    return recall.top(m.withColumn("__place", place).where(F.col("__place") <= 2 * limit).drop("__place"), "a", limit)


def search(memories: DataFrame, links: DataFrame, text: str, shards: list[str], limit: int, boost: float = 0.5) -> DataFrame:
    """(id, shard, a): trigger recall within each shard, over its memories and the links between them; each shard's 2 * limit best, then the best."""
    from recollect.operators.graph import spread_first

    of = stage(assign(memories.select("id"), "id", shards), "shards")
    hits = stage(recall.word_hits(memories, _words(text)).join(of, "id"), "hits")
    best = hits.groupBy("shard").agg(F.max("n").alias("best"))  # a row for each shard
    starts = stage(hits.join(F.broadcast(best), "shard").select("id", (F.col("n") / F.col("best")).alias("a")), "seeds")
    inside = links.join(of.toDF("from_id", "s1"), "from_id").join(of.toDF("to_id", "s2"), "to_id").where("s1 = s2").select(*links.columns)
    spread = spread_first(starts, of, stage(inside, "links"), boost=boost)
    return _best(spread.join(of, "id").select("id", "shard", F.round("a", recall.DIGITS).alias("a")), limit)


def routed(memories: DataFrame, ids: list[int], shards: list[str]) -> DataFrame:
    """memories' columns and the shard that each id is looked up in; ids that don't exist give no row."""
    at = assign(memories.sparkSession.createDataFrame([(i,) for i in ids], "id long"), "id", shards)
    return memories.join(F.broadcast(at), "id").select(*memories.columns, "shard")


def routed_upsert(memories: DataFrame, new: DataFrame, shards: list[str]) -> DataFrame:
    """memories with new ones in place of those with the same id, and the shard that each is written to."""
    from recollect.sources.store import upsert

    return assign(upsert(memories, new), "id", shards)
