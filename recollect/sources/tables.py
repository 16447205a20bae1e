"""The memory store's tables, derived row by row from the fixture tables: memories, links between them, accesses to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every query is evaluated as of this second (2024-02-01 00:00:00 UTC), never as of the clock.
AS_OF = 1706745600
_FIRST = 1704067200

TYPES = ("fact", "procedure", "episodic", "task")
#: What an access of each kind adds; kinds that aren't named add nothing and are no accesses.
BOOSTS = {"view": 0.02, "click": 0.03, "signup": 0.05, "purchase": 0.10}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values) -> Column:
    """The value that stands at place `key` (from 0) of a short constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, node_type, version, ts, activation, decay_rate, version_of, tags); ts is in seconds since 1970, UTC."""
    i = F.col("doc_id")
    kind = pick(i % 4, TYPES)
    return read(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.col("text").alias("content"),
        kind.alias("node_type"),
        (i % 5 + 1).cast("int").alias("version"),
        (F.lit(_FIRST) + (i % 720) * 3600).alias("ts"),
        ((20 + (i % 41) * 2) / F.lit(100.0)).alias("activation"),
        ((1 + i % 4) / F.lit(4000000.0)).alias("decay_rate"),
        F.when(i % 5 != 0, i - i % 5).alias("version_of"),
        F.array_compact(F.array("lang", "source", kind)).alias("tags"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, weight, link_type, pos). One link for each pair, of equal ones the last; none to itself.

    All links of a memory come from its own row, so repeats are dropped within the row and nothing is shuffled.
    """
    docs = read(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("n"))  # one row
    i, n = F.col("doc_id"), F.col("n")

    def link(to, weight, kind, pos):
        return F.struct(to.cast("long").alias("to_id"), weight.cast("double").alias("weight"), F.lit(kind).alias("link_type"), F.lit(pos).alias("pos"))

    every = F.array(
        link((i * 7 + 3) % n, (30 + 5 * (i % 14)) / F.lit(100.0), "related", 0),
        link((i * 13 + 5) % n, 5 * (1 + i % 10) / F.lit(100.0), "cross_domain", 1),
        link(F.when(i >= 10, i % 10), F.lit(0.6), "hub", 2),
        link(F.when(i % 5 != 0, i - i % 5), F.lit(0.9), "version", 3),
    )
    known = docs.select("doc_id").crossJoin(F.broadcast(total)).select("doc_id", every.alias("every"))
    last = F.filter("every", lambda x: (x["to_id"] != F.col("doc_id")) & ~F.exists("every", lambda y: F.coalesce(y["to_id"] == x["to_id"], F.lit(False)) & (y["pos"] > x["pos"])))
    return known.select(i.alias("from_id"), F.explode(last).alias("l")).select("from_id", "l.*").select("from_id", "to_id", "weight", "link_type", "pos")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts_us, boost): accesses to memories, ts_us in microseconds since 1970, UTC."""
    boost = F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(*BOOSTS))
    return e.select(F.col("user_id").alias("id"), micros("ts").alias("ts_us"), boost[F.col("event_type")].alias("boost"), "event_id")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))")


#: The same tables for DuckDB, to go before a query.
SQL_MEMORIES = """memories AS (
  SELECT doc_id AS id, text AS content, ['fact','procedure','episodic','task'][doc_id % 4 + 1] AS node_type,
         CAST(doc_id % 5 + 1 AS INTEGER) AS version, 1704067200 + (doc_id % 720) * 3600 AS ts,
         (20 + (doc_id % 41) * 2) / 100.0::DOUBLE AS activation, (1 + doc_id % 4) / 4000000.0::DOUBLE AS decay_rate,
         CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 5 END AS version_of,
         list_filter([lang, source, ['fact','procedure','episodic','task'][doc_id % 4 + 1]], lambda t: t IS NOT NULL) AS tags
  FROM documents)"""
SQL_LINKS = """drawn AS (
  SELECT doc_id AS from_id, (doc_id * 7 + 3) % n AS to_id, (30 + 5 * (doc_id % 14)) / 100.0::DOUBLE AS weight, 'related' AS link_type, 0 AS pos FROM documents, (SELECT count(*) AS n FROM documents)
  UNION ALL SELECT doc_id, (doc_id * 13 + 5) % n, 5 * (1 + doc_id % 10) / 100.0::DOUBLE, 'cross_domain', 1 FROM documents, (SELECT count(*) AS n FROM documents)
  UNION ALL SELECT doc_id, doc_id % 10, 0.6::DOUBLE, 'hub', 2 FROM documents WHERE doc_id >= 10
  UNION ALL SELECT doc_id, doc_id - doc_id % 5, 0.9::DOUBLE, 'version', 3 FROM documents WHERE doc_id % 5 <> 0
), links AS (
  SELECT * FROM drawn WHERE from_id <> to_id QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY pos DESC) = 1)"""
SQL_ACCESSES = """accesses AS (
  SELECT user_id AS id, epoch_us(ts) AS ts_us, event_id,
         CASE event_type WHEN 'view' THEN 0.02 WHEN 'click' THEN 0.03 WHEN 'signup' THEN 0.05 ELSE 0.10 END::DOUBLE AS boost
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))"""
