"""Synthetic memories and links of any number, the same for the same seed, made row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import decay

DOMAINS = ("astronomy", "botany", "cooking", "geology", "history", "law", "music", "optics", "poetry", "trade")
#: Kinds and their shares in percent.
KINDS = (("fact", 25), ("concept", 20), ("episodic", 12), ("procedural", 10), ("semantic", 10), ("note", 8), ("reference", 6), ("experience", 4), ("opinion", 3), ("working", 2))


def _draw(seed: int, what: str, most: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), F.lit(most))


def memories(spark: SparkSession, n: int, topics: int = 20, seed: int = 42) -> DataFrame:
    """n memories over domains and topics, kinds by their shares; decay and first activation by kind and position."""
    kind = F.element_at(F.array(*[F.lit(k) for k, share in KINDS for _ in range(share)]), (_draw(seed, "kind", 100) + 1).cast("int"))
    m = spark.range(n).withColumns({"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), (_draw(seed, "domain", len(DOMAINS)) + 1).cast("int")), "topic": _draw(seed, "topic", topics) + 1, "node_type": kind})
    topic = F.concat_ws("_", "domain", F.col("topic").cast("string"))
    return m.select(
        "id", F.concat(F.lit("About "), topic, F.lit(": entry "), F.col("id").cast("string"), F.lit(" on "), "domain").alias("content"), "node_type", F.lit(1).alias("version"),
        (F.lit(1704067200) + F.col("id") * 60).alias("ts"), decay.generated_activation(F.col("node_type"), F.col("id")).alias("activation"), decay.generated_decay(F.col("node_type"), F.col("id")).alias("decay_rate"),
        F.lit(None).cast("long").alias("version_of"), F.slice(F.array(F.col("domain"), topic, F.col("node_type"), F.lit("generated"), F.lit("bulk"), F.concat(F.lit("n"), (F.col("id") % 10).cast("string"))), F.lit(1), (_draw(seed, "tags", 5) + 2).cast("int")).alias("tags"),
    )


def links(spark: SparkSession, n: int, most: int = 5, seed: int = 42) -> DataFrame:
    """Up to `most` links from each memory to different earlier ones."""
    i = F.sequence(F.lit(1), (_draw(seed, "links", most) + 1).cast("int"))
    to = F.transform(i, lambda k: F.struct(F.pmod(F.xxhash64("id", k, F.lit(seed)), F.greatest(F.col("id"), F.lit(1))).alias("to_id"), k.alias("k")))
    first = F.filter(to, lambda x, p: ~F.exists(F.slice(to, F.lit(1), p), lambda y: y["to_id"] == x["to_id"]))
    one = spark.range(1, n).select(F.col("id").alias("from_id"), F.explode(first).alias("l"))
    return one.select("from_id", "l.to_id", ((F.pmod(F.xxhash64("from_id", "l.to_id"), F.lit(8)) + 2) / 10.0).alias("weight"), F.lit("related").alias("link_type"), (F.col("l.k") - 1).alias("pos"))


def tree(spark: SparkSession, domains: int = 5, each: int = 20) -> DataFrame:
    """(id, parent, domain, node_type, level): a tree for each domain, of a root, three topics, six subtopics and concepts; everything hangs under the nodes of the level before in turn."""
    p = F.col("id") % each
    level = F.when(p == 0, 1).when(p < 4, 2).when(p < 10, 3).otherwise(4)
    above = F.when(p == 0, F.lit(None)).when(p < 4, F.lit(0)).when(p < 10, 1 + (p - 4) % 3).otherwise(4 + (p - 10) % 6)
    kind = F.element_at(F.array(*map(F.lit, ("domain_root", "topic", "subtopic", "concept"))), level)
    return spark.range(domains * each).select("id", (F.col("id") - p + above).cast("long").alias("parent"), F.expr(f"id div {each}").alias("domain"), kind.alias("node_type"), level.alias("level"))
