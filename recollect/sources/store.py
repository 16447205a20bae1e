"""Writing to the store: batches of new memories, upserts, snapshots, exports, chunked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T

COLUMNS = ("id", "content", "node_type", "version", "ts", "activation", "decay_rate", "version_of", "tags")
RELATED, VERSION, CROSS = 0.6, 0.9, 0.5


def new_memories(batch: DataFrame, as_of: int) -> DataFrame:
    """Rows for the store from (id, content[, node_type, tags, version_of, version, decay_rate]); blank contents are dropped, missing tags drawn from the content.

    New memories are fully active; the other columns have their usual first values.
    """
    have = {*batch.columns}
    col = lambda name, kind, default: F.coalesce(F.col(name), default) if name in have else default.cast(kind)
    b = batch.withColumn("content", F.trim("content")).where("content != ''")
    return b.select(
        "id",
        "content",
        col("node_type", "string", F.lit("fact")).alias("node_type"),
        col("version", "int", F.lit(1)).alias("version"),
        F.lit(as_of).cast("long").alias("ts"),
        F.lit(1.0).alias("activation"),
        col("decay_rate", "double", F.lit(0.02)).alias("decay_rate"),
        (F.col("version_of") if "version_of" in have else F.lit(None).cast(batch.schema["id"].dataType)).alias("version_of"),
        col("tags", "array<string>", T.name_tags(F.col("content"))).alias("tags"),
    )


def related_links(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links of type related from (from_id, to_id) rows, to memories that exist; pos is their order by target."""
    from pyspark.sql import Window

    ok = wanted.select("from_id", "to_id").distinct().join(memories.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    pos = F.row_number().over(Window.partitionBy("from_id").orderBy("to_id")) - 1
    return ok.select("from_id", "to_id", F.lit(RELATED).alias("weight"), F.lit("related").alias("link_type"), pos.alias("pos"))


def upsert(memories: DataFrame, changed: DataFrame) -> DataFrame:
    """memories with changed rows in place of those with their id, and new ones; the larger activation stays."""
    old = memories.select(F.col("id").alias("__id"), F.struct(*[c for c in COLUMNS]).alias("old"))
    new = changed.select(F.col("id").alias("__nid"), F.struct(*[c for c in COLUMNS]).alias("new"))
    both = old.join(new, old["__id"] == new["__nid"], "full")
    row = F.coalesce("new", "old")
    return both.select(*[(F.greatest("old.activation", "new.activation") if c == "activation" else row[c]).alias(c) for c in COLUMNS])


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti").select(*memories.columns)


def point(memories: DataFrame, ident) -> DataFrame:
    return memories.where(F.col("id") == ident)


def newest(memories: DataFrame, k: int) -> DataFrame:
    """The k memories written last, for a warm start."""
    return memories.orderBy(F.desc("ts"), F.desc("id")).limit(k)


def snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a table as Parquet at a path that doesn't exist yet, in folders by a column if one is named."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)


def export_json(memories: DataFrame, links: DataFrame, form: str = "json") -> DataFrame:
    """(id, row): each memory with its links as a JSON object."""
    if form != "json":
        raise ValueError(f"no such export format: {form}")
    own = links.groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("pos", "to_id", "weight", "link_type"))).alias("links"))
    m = memories.join(own, memories["id"] == own["from_id"], "left")
    out = F.transform("links", lambda x: F.struct(x["to_id"].alias("to_id"), x["weight"].alias("weight"), x["link_type"].alias("type")))
    out = F.coalesce(out, F.array().cast(f"array<struct<to_id:{links.schema['to_id'].dataType.simpleString()},weight:double,type:string>>"))
    row = F.struct(*[c for c in COLUMNS], out.alias("links"))
    return m.select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))


def chunked(docs: DataFrame, key: str, content: str, size: int = 1000) -> DataFrame:
    """(key, chunk_no, chunk) for every slice of `size` characters."""
    return docs.select(key, F.explode(T.chunks(F.col(content), size)).alias("c")).select(key, "c.chunk_no", "c.chunk")


def chunk_links(chunks: DataFrame, key: str, back: int = 3) -> DataFrame:
    """(key, from_no, to_no): every chunk to up to `back` of those before it. Places suffice, so there is no join."""
    first = F.greatest(F.lit(0), F.col("chunk_no") - back)
    return chunks.where("chunk_no > 0").select(key, F.col("chunk_no").alias("from_no"), F.explode(F.sequence(first, F.col("chunk_no") - 1)).alias("to_no"))


def record_index(sizes: DataFrame, each: int | None = 1000) -> DataFrame:
    """(file, id, offset, bytes) of records (id, bytes) written `each` ids to a file (without it: to their column file), in order of id: where each record begins."""
    from pyspark.sql import Window

    own = sizes.withColumn("file", F.expr(f"id div {each}")) if each else sizes
    before = Window.partitionBy("file").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("file", "id", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"), "bytes")


def journal(changes: DataFrame, operation: str = "update") -> DataFrame:
    """(id, entry): a header of 128 characters for each change (id, ts, bytes), as an append-only audit table keeps it."""
    return changes.select("id", F.rpad(F.concat_ws(":", F.col("id").cast("string"), F.lit(operation), F.col("ts").cast("string"), F.col("bytes").cast("string")), 128, " ").alias("entry"))


def synced(rows: DataFrame, key: str, content, tags: list[str], node_type: str, as_of: int) -> DataFrame:
    """Rows of any table, read by whatever source, as new memories: key is their id, content an expression, tags some columns."""
    b = rows.select(F.col(key).cast("long").alias("id"), content.alias("content"), F.lit(node_type).alias("node_type"), F.array_compact(F.array(*[F.col(t).cast("string") for t in tags])).alias("tags"))
    return new_memories(b, as_of)


def from_database(spark, url: str, table: str, key: str, content, tags: list[str], node_type: str, as_of: int, **options) -> DataFrame:
    """synced over a table of a database; options as for Spark's jdbc source (partitionColumn and so on)."""
    return synced(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), key, content, tags, node_type, as_of)
