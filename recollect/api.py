"""A memory store over a folder of Parquet snapshots: insert, find, recall, link, version, maintain."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import decay, text
from recollect.operators import graph, recall, stats, versions
from recollect.plans.shared import discard, local_path, ship, stage
from recollect.sources import store

MEMORIES = "id string, content string, node_type string, version int, ts long, activation double, decay_rate double, version_of string, tags array<string>"
LINKS = "from_id string, to_id string, weight double, link_type string, pos int"
ACCESSES = "id string, ts_us long, event_id long, boost double"

#: Parts that a table may have before they are written together.
PARTS = 16


@dataclass(frozen=True)
class Settings:
    """All that operators can be told; the defaults are the store's usual ones."""

    decay_model: str = "exponential"
    floor: float = decay.FLOOR
    active: float = 0.1
    read_boost: float = 0.05
    boost: float = 0.1
    related_depth: int = 2
    search_mode: str = "balanced"
    keep_versions: int = versions.MAX_VERSIONS


@dataclass
class Store:
    """Tables are immutable: new rows are written beside the parts that a table has, any other change writes it anew.

    Reading changes nothing. Accesses are rows of their own, folded into activations by `settle`. All times are given.
    Batches that are `put` wait until they are `flush`ed together, as they are by any reading of statistics or change.
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    memories: DataFrame | None = None
    links: DataFrame | None = None
    accesses: DataFrame | None = None

    def __post_init__(self) -> None:
        ship(self.spark)
        self._pending: list[tuple[DataFrame, int]] = []
        self._own: list[DataFrame] = []
        self._parts: dict[str, int] = {}
        for name, schema in (("memories", MEMORIES), ("links", LINKS), ("accesses", ACCESSES)):
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], schema))

    def _set(self, name: str, df: DataFrame) -> None:
        staged = stage(df, name)
        setattr(self, name, staged)
        self._own.append(staged)  # the one before stays until the store is closed: results may be lazy
        self._parts[name] = 0

    def _append(self, name: str, rows: DataFrame) -> None:
        """Write rows alone, beside the parts that the table has; many parts are written together."""
        staged = stage(rows, name)
        self._own.append(staged)
        setattr(self, name, getattr(self, name).unionByName(staged))
        self._parts[name] = self._parts.get(name, 0) + 1
        if self._parts[name] > PARTS:
            self._set(name, getattr(self, name))

    @staticmethod
    def _now(as_of: int | None) -> int:
        return int(time.time()) if as_of is None else as_of

    # ---- writing

    def put(self, batch: DataFrame, as_of: int | None = None) -> None:
        """Note a batch of (id, content, ...) to be written with others by `flush`."""
        self._pending.append((batch, self._now(as_of)))

    def flush(self) -> int:
        """Write all batches that wait, as one snapshot; gives how many they were. Of rows with one id the last batch's stay."""
        waiting, self._pending = self._pending, []
        if waiting:
            rows = [store.new_memories(b, at).select(*self.memories.columns).withColumn("__n", F.lit(n)) for n, (b, at) in enumerate(waiting)]
            every = rows[0]
            for r in rows[1:]:
                every = every.unionByName(r)
            last = every.groupBy("id").agg(F.max_by(F.struct(*self.memories.columns), "__n").alias("r")).select("r.*")
            self._write(last)
        return len(waiting)

    def _write(self, new: DataFrame) -> None:
        """Append memories, or write the table anew where some of them exist."""
        new = stage(new, "new")
        if self.memories.join(new.select("id"), "id", "left_semi").isEmpty() and new.groupBy("id").count().where("count > 1").isEmpty():
            self._append("memories", new.select(*[F.col(c).cast(self.memories.schema[c].dataType).alias(c) for c in self.memories.columns]))
            return
        self._set("memories", store.upsert(self.memories, new).select(*[F.col(c).cast(self.memories.schema[c].dataType).alias(c) for c in self.memories.columns]))

    def insert_many(self, batch: DataFrame, related: DataFrame | None = None, as_of: int | None = None) -> None:
        """Add a batch of (id, content, ...); related: (from_id, to_id), of which only existing targets are linked."""
        new = store.new_memories(batch, self._now(as_of)).select(*self.memories.columns)
        self._write(new)
        if related is not None:
            self._append("links", store.related_links(self.memories, related).select(*[F.col(c).cast(self.links.schema[c].dataType).alias(c) for c in self.links.columns]))

    def insert(self, content: str, node_type: str = "fact", tags: list[str] | None = None, related: Iterable[str] = (), as_of: int | None = None, version_of: str | None = None, decay_rate: float = 0.02) -> str:
        """Add one memory and return its id; a blank content is an error. Each call writes a part of its own: for many use insert_many, or put and flush."""
        if not content or not content.strip():
            raise ValueError("a memory needs a content")
        ident = str(uuid.uuid4())
        row = self.spark.createDataFrame([(ident, content, node_type, tags, version_of, decay_rate)], "id string, content string, node_type string, tags array<string>, version_of string, decay_rate double")
        wanted = self.spark.createDataFrame([(ident, r) for r in related], "from_id string, to_id string")
        self.insert_many(row, wanted, as_of)
        return ident

    def new_version(self, of: str, content: str, as_of: int | None = None) -> str:
        if store.point(self.memories, of).isEmpty():
            raise KeyError(of)
        ident = str(uuid.uuid4())
        root = versions.roots(self.memories)
        chain = self.memories.join(root, "id").join(F.broadcast(root.where(F.col("id") == of).select("root")), "root", "left_semi")
        first = chain.agg(F.max("root").alias("root"), (F.max("version") + 1).alias("next")).first()
        old = store.point(self.memories, of)
        row = old.withColumns({"id": F.lit(ident), "content": F.lit(content), "version": F.lit(first.next), "ts": F.lit(self._now(as_of)).cast("long"), "activation": F.lit(1.0), "version_of": F.lit(first.root)})
        self._append("memories", row)
        kept = self.links.where(F.col("from_id") == of).withColumn("from_id", F.lit(ident))
        to_root = self.spark.createDataFrame([(ident, first.root, store.VERSION, "version", 1 << 20)], LINKS)
        self._append("links", kept.unionByName(to_root))
        return ident

    def link(self, from_id: str, to_id: str, weight: float = 0.5, link_type: str = "related") -> None:
        if not 0 <= weight <= 1:
            raise ValueError("a weight lies between 0 and 1")
        ends = {r.id for r in self.memories.where(F.col("id").isin(from_id, to_id)).select("id").collect()}
        if missing := {from_id, to_id} - ends:
            raise KeyError(*missing)
        rest = self.links.where(~((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("link_type") == link_type)))
        pos = rest.where(F.col("from_id") == from_id).agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("p")).first().p
        self._set("links", rest.unionByName(self.spark.createDataFrame([(from_id, to_id, float(weight), link_type, pos)], LINKS)))

    def access(self, ids: list[str], boost: float | None = None, as_of: int | None = None) -> None:
        """Note accesses, to be folded into activations later."""
        at = self._now(as_of) * 1_000_000
        rows = [(i, at, k, self.settings.boost if boost is None else boost) for k, i in enumerate(ids)]
        self._append("accesses", self.spark.createDataFrame(rows, ACCESSES))

    def settle(self, as_of: int | None = None) -> None:
        """Fold accesses and decay into the activations, which then are as of that time."""
        now = self._now(as_of)
        a = stats.fold(self.memories, self.accesses, now).select(F.col("id").alias("__id"), F.greatest(F.lit(self.settings.floor), "activation").alias("__a"))
        m = self.memories.join(a, self.memories["id"] == F.col("__id"))
        m = m.withColumns({"activation": F.col("__a"), "ts": F.greatest("ts", F.lit(now).cast("long"))}).select(*self.memories.columns)
        self._set("memories", m)
        self._set("accesses", self.accesses.where(F.col("ts_us") > now * 1_000_000))

    def update_activation(self, ident: str, boost: float | None = None, as_of: int | None = None) -> float:
        """Boost one memory, as two readings and the boost do, and return its activation as of now; an error if it doesn't exist."""
        now = self._now(as_of)
        if store.point(self.memories, ident).isEmpty():
            raise KeyError(ident)
        for b in (self.settings.read_boost, self.settings.read_boost, self.settings.boost if boost is None else boost):
            self.access([ident], b, now)
        self.settle(now)
        return store.point(self.memories, ident).first().activation

    def set_weight(self, from_id: str, to_id: str, weight: float) -> None:
        """Another weight for the first link between two memories; an error if there is none."""
        self._set("links", graph.set_weight(self.links, from_id, to_id, weight))

    def cleanup(self, least: float = 0.01, as_of: int | None = None) -> int:
        """Decay everything to now, remove what is at `least` or below, by default the floor of decay, and the links from it; gives how many went."""
        self.settle(as_of)
        gone = self.memories.where(F.col("activation") <= least).select("id")
        n = gone.count()
        if n:
            kept = stage(gone, "gone")
            self._set("links", self.links.join(kept.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(*self.links.columns))
            self._set("memories", store.delete(self.memories, kept))
            discard(kept)
        return n

    def sync(self, rows: DataFrame, key: str, content, tags: list[str], node_type: str = "fact", as_of: int | None = None) -> None:
        """Take the rows of any table in as memories, in place of those with their id; see store.synced."""
        self._write(store.synced(rows, key, content, tags, node_type, self._now(as_of)).withColumn("id", F.col("id").cast("string")).select(*self.memories.columns))

    def close(self) -> None:
        """Write what waits, and delete the snapshots in the shared folder; what was backed up stays. The store is empty then."""
        self.flush()
        discard(*self._own)
        self._own.clear()
        for name, schema in (("memories", MEMORIES), ("links", LINKS), ("accesses", ACCESSES)):
            setattr(self, name, self.spark.createDataFrame([], schema))

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- notes

    def add_note(self, title: str, body: str, category: str = "general", tags: Iterable[str] = ()) -> str:
        """A note; its first tag is its category."""
        return self.insert(f"{title}\n\n{body}", "fact", [category, "note", *tags])

    def add_article(self, url: str, title: str, summary: str, tags: Iterable[str] = ()) -> str:
        """What a web page says."""
        return self.insert(f"{title}\n{url}\n\n{summary}", "fact", ["web", "reference", *tags])

    def add_book_note(self, book: str, author: str, page: int, note: str, tags: Iterable[str] = ()) -> str:
        """A note on a page of a book; notes on one book are found by its tag."""
        return self.insert(f"{book} ({author}), p. {page}: {note}", "fact", ["books", "book_note", text.tag_of(book), *tags])

    def prune_links(self, least: float = 0.1) -> None:
        self._set("links", graph.prune(self.links, least))

    # ---- reading

    def get(self, ident: str, as_of: int | None = None) -> DataFrame:
        """The memory with its activation decayed to now and boosted by this reading; the table stays as it is."""
        now = self._now(as_of)
        m = store.point(self.memories, ident)
        a = decay.apply_decay(F.col("activation"), F.col("decay_rate"), F.lit(now) - F.col("ts"), self.settings.decay_model, self.settings.floor)
        return m.withColumn("activation", decay.boosted(a, self.settings.read_boost))

    def search(self, text: str | None = None, tags: list[str] | None = None, limit: int = 10, as_of: int | None = None, note: bool = False) -> DataFrame:
        """What a text, else tags, recall; without either what is most active. note: the results are noted as accesses, for `settle`."""
        now = self._now(as_of)
        if text:
            found = recall.content_recall(self.memories, text, limit, now, self.settings.search_mode)
        else:
            found = recall.recall(self.memories, None, tags, limit, now)
        if note:
            found = stage(found, "results")
            self.access([r.id for r in found.select("id").collect()], 0.03, now)
        return found

    # the names that a storage adapter has
    read_node_by_id = get_node = get

    def append_node(self, batch: DataFrame, as_of: int | None = None) -> None:
        self.insert_many(batch, as_of=as_of)

    def update_node(self, changed: DataFrame) -> None:
        """Whole rows in place of those with their id, and new ones; the larger activation stays."""
        self._write(changed.select(*self.memories.columns))

    def apply_global_decay(self, as_of: int | None = None) -> int:
        """Settle all accesses and decay; gives the number of memories."""
        self.settle(as_of)
        return self.memories.count()

    def get_storage_stats(self) -> dict:
        return self.statistics()

    def optimize(self) -> None:
        """Write every table as one part."""
        for name in ("memories", "links", "accesses"):
            self._set(name, getattr(self, name))

    def get_all_nodes(self) -> DataFrame:
        return self.memories

    def by_type(self, node_type: str, limit: int = 10) -> DataFrame:
        return recall.by_type(self.memories, node_type, limit)

    def by_activation(self, least: float, limit: int = 100) -> DataFrame:
        return recall.by_activation(self.memories, least, limit)

    def by_tags(self, tags: list[str], match_all: bool = False) -> DataFrame:
        return recall.tags_match(self.memories, tags, match_all)

    def record_sizes(self) -> DataFrame:
        """(id, bytes) of each memory's binary record."""
        kinds = self.links.groupBy(F.col("from_id").alias("id")).agg(F.collect_list("link_type").alias("kinds"))
        size = text.record_bytes(F.col("content"), F.col("node_type"), F.col("version_of"), F.col("tags"), F.col("kinds"))
        return self.memories.join(kinds, "id", "left").select("id", size.alias("bytes"))

    def record_index(self) -> DataFrame:
        """(file, id, offset, bytes): where each record begins in files of one leading character of the id each."""
        return store.record_index(self.record_sizes().withColumn("file", F.substring("id", 1, 1)), None)

    def journal(self) -> DataFrame:
        """(id, entry): the audit table's header of each memory as it is."""
        return store.journal(self.memories.select("id", "ts").join(self.record_sizes(), "id"))

    def related(self, ident: str, limit: int = 10) -> DataFrame:
        at = self.spark.createDataFrame([(ident, 1.0)], "id string, a double")
        found = graph.spread_sum(at, self.links, self.settings.related_depth).where(F.col("id") != ident)
        return recall.top(found.join(self.memories, "id"), "score", limit)

    def explore(self, text: str, limit: int = 5) -> DataFrame:
        """What is related to the best hit of a search; nothing where there is no hit."""
        best = self.search(text, limit=1, as_of=0).select("id").first()
        return self.related(best.id, limit) if best else self.memories.where("1 = 0").withColumn("score", F.lit(0.0))

    def chain(self, ident: str) -> DataFrame:
        """All versions of a memory in order."""
        c = versions.chains(self.memories)
        return c.join(F.broadcast(c.where(F.col("id") == ident).select("root")), "root", "left_semi").orderBy("place")

    def statistics(self) -> dict:
        """Counts and means of the tables, bytes and files of their snapshots, and batches that wait."""
        out = stats.store(self.memories, self.links, self.settings.active).first().asDict()
        files = [f for t in (self.memories, self.links, self.accesses) for f in t.inputFiles()]
        return out | {"files": len(files), "bytes": sum(os.path.getsize(local_path(f)) for f in files if f.startswith(("/", "file:"))), "pending": len(self._pending)}

    def export(self, form: str = "json") -> DataFrame:
        return store.export_json(self.memories.select(*store.COLUMNS), self.links.select("from_id", F.col("to_id"), "weight", "link_type", "pos"), form)

    def backup(self, folder: str) -> None:
        """Write all tables below a folder that doesn't hold any yet."""
        for name in ("memories", "links", "accesses"):
            store.snapshot(getattr(self, name), f"{folder.rstrip('/')}/{name}")

    @classmethod
    def restore(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> Store:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
        return cls(spark, settings or Settings(), read("memories", MEMORIES), read("links", LINKS), read("accesses", ACCESSES))


def quick_search(store_: Store, text: str, limit: int = 5) -> list[str]:
    return [r.content for r in store_.search(text, limit=limit).select("content").collect()]
