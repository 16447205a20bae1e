"""Version chains: roots, members, latest and original, consolidation, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.plans.shared import stage

#: Versions of a chain that pruning always keeps; older ones stay only with this much activation.
MAX_VERSIONS, MIN_ACTIVATION = 5, 0.1


def roots(memories: DataFrame) -> DataFrame:
    """(id, root): where following version_of ends. On a loop, or where a memory is missing on the way, it is the memory itself.

    Pointers double their reach with every round, so rounds grow with the logarithm of the longest chain. They end when
    all pointers stand still or, on loops, when a round settles none.
    """
    m = memories.select("id", "version_of")
    parent = m.select(F.col("id").alias("p"), F.lit(True).alias("known"))
    at = m.join(parent, m["version_of"] == parent["p"], "left")
    # settled: true at a root, false where the way breaks off, null while under way
    at = at.select("id", F.coalesce("version_of", "id").alias("at"), F.when(F.col("version_of").isNull(), True).when(F.col("known").isNull(), False).alias("settled"))
    at, left = stage(at, "pointers"), None
    while True:
        open_ = at.where("settled is null").count()
        if open_ in (0, left):
            return at.select("id", F.when(F.coalesce("settled", F.lit(False)), F.col("at")).otherwise(F.col("id")).alias("root"))
        left = open_
        next_ = at.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("settled").alias("there"))
        moved = at.where("settled is null").join(next_, "at").select("id", F.col("next").alias("at"), F.col("there").alias("settled"))
        at = stage(at.where("settled is not null").unionByName(moved), "pointers")


def chains(memories: DataFrame) -> DataFrame:
    """memories with `root`, and `place` from 1 in the order of versions within the chain (ties by id)."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("version", "id"))
    return memories.join(roots(memories), "id").withColumn("place", place)


def latest(memories: DataFrame) -> DataFrame:
    """(root, id, version): the last of each chain."""
    m = memories.select("id", "version").join(roots(memories), "id")
    return m.groupBy("root").agg(F.max(F.struct("version", "id")).alias("m")).select("root", "m.id", "m.version")


def originals(memories: DataFrame) -> DataFrame:
    """(id, original_id, original_version) for every memory."""
    first = memories.select(F.col("id").alias("root"), F.col("version").alias("original_version"))
    return roots(memories).join(first, "root").select("id", F.col("root").alias("original_id"), "original_version")


def next_versions(memories: DataFrame) -> DataFrame:
    """(root, next_version): one more than the largest of the chain."""
    m = memories.select("id", "version").join(roots(memories), "id")
    return m.groupBy("root").agg((F.max("version") + 1).alias("next_version"))


def statistics(memories: DataFrame) -> DataFrame:
    """One row: memories, roots, versioned ones, chains of more than one, the longest, the average length, the share of versioned ones."""
    sizes = roots(memories).groupBy("root").agg(F.count("*").alias("n"))
    chain = sizes.agg(
        F.count_if(F.col("n") > 1).alias("chains"),
        F.coalesce(F.max("n"), F.lit(0)).alias("longest"),
        F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("n"))), F.lit(0.0)).alias("mean_length"),
    )
    total = memories.agg(F.count("*").alias("total"), F.count_if(F.col("version_of").isNull()).alias("roots"), F.count_if(F.col("version_of").isNotNull()).alias("versioned"))
    return total.crossJoin(chain).withColumn("ratio", F.coalesce(F.try_divide("versioned", "total"), F.lit(0.0)))


def consolidate(memories: DataFrame, keep_latest: bool = True) -> DataFrame:
    """One memory for each chain: its last (or first) one's id, content, type, ts and decay; the largest activation, the tags of
    all in order of appearance, as version the length of the chain, and no version_of."""
    c = chains(memories)
    pick = F.max_by if keep_latest else F.min_by
    main = pick(F.struct("id", "content", "node_type", "ts", "decay_rate"), "place")
    one = c.groupBy("root").agg(main.alias("m"), F.count("*").cast("int").alias("version"), F.max("activation").alias("activation"), F.array_sort(F.collect_list(F.struct("place", "tags"))).alias("all"))
    return one.select(
        "m.id", "m.content", "m.node_type", "version", "m.ts", "activation", "m.decay_rate", F.lit(None).cast("long").alias("version_of"), F.array_distinct(F.flatten(F.transform("all", lambda x: x["tags"]))).alias("tags"), "root"
    )


def consolidate_links(memories: DataFrame, links: DataFrame, keep_latest: bool = True) -> DataFrame:
    """The links of consolidated memories: for each chain and target the first, by version and place."""
    c = chains(memories).select("id", "root", "place")
    main = c.groupBy("root").agg((F.max_by if keep_latest else F.min_by)("id", "place").alias("main"))
    own = links.join(c, links["from_id"] == c["id"])
    first = own.groupBy("root", "to_id").agg(F.min(F.struct("place", "pos", "weight", "link_type")).alias("f"))
    return first.join(main, "root").select(F.col("main").alias("from_id"), "to_id", "f.weight", "f.link_type")


def prunable(memories: DataFrame, keep: int = MAX_VERSIONS, least: float = MIN_ACTIVATION) -> DataFrame:
    """(root, id): versions that pruning would remove: not among the newest of their chain, and too little active."""
    new = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("version"), "id"))
    return memories.join(roots(memories), "id").withColumn("new", new).where((F.col("new") > keep) & (F.col("activation") < least)).select("root", "id")


def new_version(memories: DataFrame, links: DataFrame, of: int, new_id: int, content: str, as_of: int) -> tuple[DataFrame, DataFrame]:
    """The row of a new version of a memory, and its links: those of the original and one of type version to the root."""
    root = roots(memories).where(F.col("id") == of).select("root")
    chain = memories.join(roots(memories), "id").join(F.broadcast(root), "root", "left_semi")
    number = chain.agg((F.max("version") + 1).cast("int").alias("version"), F.max("root").alias("version_of"))
    old = memories.where(F.col("id") == of).select("node_type", "decay_rate", "tags")
    row = old.crossJoin(number).select(F.lit(new_id).cast("long").alias("id"), F.lit(content).alias("content"), "node_type", "version", F.lit(as_of).cast("long").alias("ts"), F.lit(1.0).alias("activation"), "decay_rate", "version_of", "tags")
    kept = links.where(F.col("from_id") == of).withColumn("from_id", F.lit(new_id).cast("long"))
    to_root = root.select(F.lit(new_id).cast("long").alias("from_id"), F.col("root").alias("to_id"), F.lit(0.9).alias("weight"), F.lit("version").alias("link_type"), F.lit(1 << 20).alias("pos"))
    return row, kept.unionByName(to_root)
