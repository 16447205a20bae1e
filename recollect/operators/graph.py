"""Links and traversals: spreading activation in its variants, paths, components, link maintenance."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.plans.shared import discard, fits, join_sized, stage

SPREAD = 0.7
#: Hops that are planned as one query; with more, each further hop's frontier is written to the shared folder.
UNROLLED = 3


def spread_sum(starts: DataFrame, links: DataFrame, depth: int, cut: float = 0.1) -> DataFrame:
    """(id, score): activation that arrives over up to `depth` hops, summed. starts: (id, a).

    Hop k passes a * weight * 0.7^k; all of it counts, but only what is above the cut goes on, the largest for each
    memory. Starting memories are in the result only if they are reached again. Targets needn't exist.
    """
    edges = links.select("from_id", "to_id", "weight")
    frontier, passed = starts.select("id", "a"), []
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["id"] == edges["from_id"]).select(F.col("to_id").alias("id"), (F.col("a") * F.col("weight") * SPREAD**hop).alias("x"))
        # partial sums keep each hop's output no larger than the number of memories reached
        own = step.groupBy("id").agg(F.sum("x").alias("score"), F.max("x").alias("a"))
        if hop > UNROLLED:
            own = stage(own, f"spread-{hop}")
        passed.append(own.select("id", "score"))
        frontier = own.where(F.col("a") > cut).select("id", "a")
    return reduce(DataFrame.unionByName, passed).groupBy("id").agg(F.sum("score").alias("score"))


def spread_max(starts: DataFrame, memories: DataFrame, links: DataFrame, hops: int = 3, cut: float = 0.01) -> DataFrame:
    """(id, a): starts at 1, then in every hop all that is active passes a * weight * 0.7^hop on, of which the largest stays.

    Only existing memories pass or receive. Hops are synchronous: each sees the values of the one before.
    """
    have = memories.select("id")
    edges = links.join(have.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(have.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    edges = edges.select("from_id", "to_id", "weight")
    active = starts.select("id", F.lit(1.0).alias("a"))
    for hop in range(1, hops + 1):
        x = active.join(edges, active["id"] == edges["from_id"]).select(F.col("to_id").alias("id"), (F.col("a") * F.col("weight") * SPREAD**hop).alias("a")).where(F.col("a") >= cut)
        active = active.unionByName(x).groupBy("id").agg(F.max("a").alias("a"))
        if hop > UNROLLED:
            active = stage(active, f"spread-{hop}")
    return active.where(F.col("a") >= cut)


def spread_first(starts: DataFrame, memories: DataFrame, links: DataFrame, boost: float = 1.0, hops: int = 3, cut: float = 0.01) -> DataFrame:
    """(id, a): each memory that is newly reached takes the value of the first link that reaches it, times boost, and goes on from there.

    First is by the places of the links along the way (the start's id, then pos of each link): the order of a queue,
    carried in an array, so no hop needs a global numbering. starts: (id, a). Memories that don't exist pass nothing on.
    """
    have = memories.select("id")
    edges = links.join(have.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select("from_id", "to_id", "weight", "pos")
    seen = starts.select("id", "a")
    frontier = starts.select("id", "a", F.array(F.col("id").cast("long")).alias("way"))
    for hop in range(1, hops + 1):
        passed = F.col("a") * F.col("weight") * SPREAD**hop
        x = frontier.join(edges, frontier["id"] == edges["from_id"]).select(F.col("to_id").alias("id"), passed.alias("x"), F.concat("way", F.array(F.col("pos").cast("long"))).alias("way"))
        x = x.where(F.col("x") > cut).groupBy("id").agg(F.min(F.struct("way", "x")).alias("first"))
        new = x.join(seen.select("id"), "id", "left_anti").select("id", (F.col("first.x") * boost).alias("a"), F.col("first.way").alias("way"))
        if hop < hops or hop > UNROLLED:
            new = stage(new, f"reached-{hop}")  # it is read twice: by the next hop and for what was seen
        seen, frontier = seen.unionByName(new.select("id", "a")), new
    return seen


def within(start: DataFrame, links: DataFrame, memories: DataFrame, depth: int) -> DataFrame:
    """(id, hops): existing memories within so many links of the start (id), the start aside."""
    edges, have = links.select("from_id", "to_id"), memories.select("id")
    seen = start.select("id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        x = frontier.join(edges, frontier["id"] == edges["from_id"]).select(F.col("to_id").alias("id")).distinct()
        frontier = x.join(seen.select("id"), "id", "left_anti").join(have, "id", "left_semi").withColumn("hops", F.lit(hop))
        if depth > UNROLLED:
            frontier = stage(frontier, f"within-{hop}")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def find_path(spark, links: DataFrame, start: int, goal: int, depth: int = 3, least: float = 0.1) -> DataFrame:
    """(path): the ids of a shortest way over links of at least that weight, heavier links first; no row without one."""
    if start == goal:
        return spark.createDataFrame([([start],)], "path array<long>")
    edges = links.where(F.col("weight") >= least).select("from_id", "to_id", "weight")
    frontier = spark.createDataFrame([(start, [start])], "id long, path array<long>").withColumn("way", F.array().cast("array<struct<w:double,id:long>>"))
    seen, found = frontier.select("id"), []
    for hop in range(1, depth + 1):
        x = frontier.join(edges, frontier["id"] == edges["from_id"])
        x = x.select(F.col("to_id").alias("id"), F.concat("way", F.array(F.struct((-F.col("weight")).alias("w"), F.col("to_id").alias("id")))).alias("way"), F.concat("path", F.array("to_id")).alias("path"))
        x = x.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("way", "path")).alias("m")).select("id", "m.way", "m.path")
        if hop < depth:
            x = stage(x, f"path-{hop}")
        found.append(x.where(F.col("id") == goal).select("path", F.lit(hop).alias("hops")))
        seen, frontier = seen.unionByName(x.select("id")), x
    every = reduce(DataFrame.unionByName, found)
    return every.orderBy("hops").limit(1).select("path")


def components(links: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, component): the smallest memory from which each can be reached over links of at least that weight; components of more than one.

    A round carries labels over up to UNROLLED links, from those that changed in the last round only, and every node then
    takes the label of its label; so a round moves what is still in motion, as one job. Every round is written to the shared
    folder in place of the last.
    """
    edges = stage(links.where(F.col("weight") >= least).select("from_id", "to_id").distinct(), "edges")
    ids = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id"))).distinct()
    labels = stage(ids.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        every, front = labels.select("id", "label", F.col("label").alias("old")), labels.where("moved").select("id", "label")
        for _ in range(UNROLLED):
            over = front.join(edges, front["id"] == edges["from_id"]).select(F.col("to_id").alias("id"), "label")
            front = over.groupBy("id").agg(F.min("label").alias("label"))
            every = every.unionByName(front.withColumn("old", F.lit(None).cast("long")))
        new = every.groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = stage(new.join(up, "label").select("id", F.col("up").alias("label"), (F.col("up") != F.col("old")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            break
    sizes = stage(labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label"), "components")
    return join_sized(labels.select("id", "label"), sizes, "label", "left_semi", 16).select("id", F.col("label").alias("component"))


def linked(links: DataFrame, least: float = 0.0) -> DataFrame:
    """Links of at least that weight, whether their target exists or not."""
    return links.where(F.col("weight") >= least)


def related(links: DataFrame, memories: DataFrame, least: float = 0.0) -> DataFrame:
    """Links of at least that weight to memories that exist."""
    return linked(links, least).join(memories.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*links.columns)


def find_related(spark, memories: DataFrame, links: DataFrame, start: int, depth: int = 2) -> DataFrame:
    """memories reached from one at full activation, with the score that spread to them, the start aside."""
    at = spark.createDataFrame([(start, 1.0)], "id long, a double")
    return spread_sum(at, links, depth).where(F.col("id") != start).join(memories, "id")


def upsert_links(links: DataFrame, new: DataFrame, memories: DataFrame) -> DataFrame:
    """links with new ones (without pos) in place of those with the same ends and type; weights are held to 0..1; both ends must exist."""
    have = memories.select("id")
    ok = new.join(have.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(have.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    ok = ok.select("from_id", "to_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")).alias("weight"), "link_type", F.lit(True).alias("fresh"))
    old = links.select("from_id", "to_id", "weight", "link_type", F.lit(False).alias("fresh"))
    return old.unionByName(ok).groupBy("from_id", "to_id", "link_type").agg(F.max_by("weight", F.struct("fresh", "weight")).alias("weight")).select("from_id", "to_id", "weight", "link_type")


def set_weight(links: DataFrame, from_id, to_id, weight: float) -> DataFrame:
    """links with another weight for the first link (by pos) from one memory to another; an error if there is none."""
    if not 0 <= weight <= 1:
        raise ValueError("a weight lies between 0 and 1")
    here = (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    first = links.where(here).agg(F.min("pos").alias("pos")).first().pos
    if first is None:
        raise KeyError(f"no link from {from_id} to {to_id}")
    return links.withColumn("weight", F.when(here & (F.col("pos") == first), weight).otherwise(F.col("weight")))


def prune(links: DataFrame, least: float = 0.1) -> DataFrame:
    return links.where(F.col("weight") >= least)


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): different memories that one has links to or from."""
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    return both.distinct().groupBy("id").agg(F.count("*").alias("degree"))


def _tag_classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tags) with the set of tags in order, and the pairs (a, b, common, n) of such sets that have a tag in common; n: memories with b."""
    own = memories.select("id", F.array_sort(F.array_distinct("tags")).alias("tags"))
    classes = stage(own.groupBy("tags").agg(F.count("*").alias("n")), "tag-sets")
    a, b = classes.select(F.col("tags").alias("a")), classes.select(F.col("tags").alias("b"), "n")
    return own, a.withColumn("t", F.explode("a")).join(b.withColumn("t", F.explode("b")), "t").groupBy("a", "b").agg(F.count("*").alias("common"), F.first("n").alias("n"))


def shared_tags(memories: DataFrame, least: int = 2) -> DataFrame:
    """(id, n_edges, weight): with how many other memories one has `least` tags or more in common, and how many tags in all.

    Memories with the same set of tags are one class; classes are compared, never memories, so the work grows with the
    number of different tag sets and not with the square of the table.
    """
    own, pairs = _tag_classes(memories)
    others = F.col("n") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    found = pairs.where(F.col("common") >= least).groupBy("a").agg(F.sum(others).alias("n_edges"), F.sum(others * F.col("common")).alias("weight")).where("n_edges > 0")
    return own.join(found, own["tags"] == found["a"]).select("id", "n_edges", "weight")


#: Ids of one tag set that are compared at once, ids of a row group's repeats, and pairs that a task writes.
BLOCK, RUN, TASK_PAIRS = 2048, 256, 1 << 26


def shared_tag_edges(memories: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, weight), a < b: the pairs themselves. Their number grows with the square of the memories that share tags.

    Tag sets are compared as by shared_tags. The ids of a set lie in sorted blocks, and only pairs of blocks travel: a task
    takes them apart into its share of the pairs, so these are only written, never shuffled. They are made run by run, a
    run's ids over and over in the same order, which Parquet stores in a fraction of a byte each.
    """
    from recollect.operators.layout import numbered

    own, pairs = _tag_classes(memories)
    near = stage(pairs.where(F.col("common") >= least).select(F.col("a").alias("tags"), F.col("b").alias("others"), F.col("common").alias("weight"), "n"), "near-sets")
    place = numbered(own.where("id is not null").withColumn("key", F.struct("tags", "id")), "key")
    blocks = place.groupBy("tags", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    blocks = stage(blocks.select("tags", "block", "ids", F.col("ids")[0].alias("least"), F.element_at("ids", -1).alias("most")), "tag-blocks")
    left = blocks.select("tags", F.col("block").alias("x"), F.col("least").alias("lo"))
    right = blocks.select(F.col("tags").alias("others"), F.col("block").alias("y"), F.col("most").alias("hi"))
    met = near.drop("n").join(left, "tags").join(right, "others").where("lo < hi").select("tags", "x", "others", "y", "weight")
    a, b = blocks.select("tags", F.col("block").alias("x"), F.col("ids").alias("xs")), blocks.select(F.col("tags").alias("others"), F.col("block").alias("y"), F.col("ids").alias("ys"))
    sizes = blocks.groupBy("tags").agg(F.sum(F.size("ids")).alias("m"))
    n = near.join(sizes, "tags").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0
    tasks = max(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n / 2 / TASK_PAIRS))
    if fits(blocks, 8 * BLOCK):
        met = met.repartition(tasks, "x", "y", "weight").join(F.broadcast(a), ["tags", "x"]).join(F.broadcast(b), ["others", "y"])
    else:
        met = met.join(a, ["tags", "x"]).join(b, ["others", "y"]).repartition(tasks, "x", "y", "weight")
    runs = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), lambda k: F.slice(c, k * RUN + 1, RUN)))
    met = met.select(runs("xs").alias("xs"), "ys", "weight").select("xs", runs("ys").alias("ys"), "weight").where(F.col("xs")[0] < F.element_at("ys", -1))
    return met.select(F.explode("xs").alias("a"), "ys", "weight").select("a", F.explode("ys").alias("b"), "weight").where("a < b")


def typed(links: DataFrame, memories: DataFrame, domain, day: int = 86400) -> DataFrame:
    """links with a type by what they join: semantic within a domain, temporal within a day, else associative. domain: a column of memories."""
    m = memories.select("id", domain.alias("d"), "ts")
    a, b = m.toDF("from_id", "d1", "t1"), m.toDF("to_id", "d2", "t2")
    kind = F.when(F.col("d1") == F.col("d2"), "semantic").when(F.abs(F.col("t1") - F.col("t2")) < day, "temporal").otherwise("associative")
    return links.join(a, "from_id").join(b, "to_id").select("from_id", "to_id", "weight", kind.alias("link_type"))


def chosen_related(memories: DataFrame, domain, topic, most: int = 5) -> DataFrame:
    """(from_id, to_id, kind): whom a new memory is linked with: of those before it by id the last three of its topic, the last two of its domain unless of its topic, and for every tenth id the last two of all unless of its domain; at most `most`.

    domain, topic: columns of memories. Memories are numbered by topic, by domain and by id, without one task that sees them
    all, and joined by their numbers.
    """
    from recollect.operators.layout import numbered

    own = memories.select("id", domain.alias("domain"), topic.alias("topic"))
    found = []
    for rank, kind, by, n, ok in (
        (0, "topic", ["topic", "id"], 3, F.col("topic") == F.col("t2")),
        (1, "domain", ["domain", "id"], 2, (F.col("domain") == F.col("d2")) & (F.col("topic") != F.col("t2"))),
        (2, "cross", ["id"], 2, (F.col("domain") != F.col("d2")) & (F.col("id") % 10 == 0)),
    ):
        i = numbered(own.withColumn("key", F.struct(*by)), "key").select("id", "domain", "topic", "i")
        other = i.select((F.col("i")).alias("at"), F.col("id").alias("to_id"), F.col("domain").alias("d2"), F.col("topic").alias("t2"))
        near = i.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("at", F.col("i") - F.col("k")).join(other, "at").where(ok)
        found.append(near.select(F.col("id").alias("from_id"), "to_id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "k"))
    every = reduce(DataFrame.unionByName, found)
    place = F.row_number().over(Window.partitionBy("from_id").orderBy("rank", "k"))
    return every.withColumn("place", place).where(F.col("place") <= most).select("from_id", "to_id", "kind")


def sampled_links(memories: DataFrame, domain, most: int = 100, of: int = 10, keep: int = 3, day: int = 86400) -> DataFrame:
    """(a, b, link_type), a < b: of the pairs among the `most` most active memories those that a number made of their ids picks, `keep` of `of`, typed as by typed.

    The `most` rows are one array, which is taken apart into pairs.
    """
    top = memories.select("id", domain.alias("d"), "ts", "activation").orderBy(F.desc("activation"), "id").limit(most)
    one = top.agg(F.array_sort(F.collect_list(F.struct("id", "d", "ts"))).alias("m"))
    first = one.select("m", F.posexplode("m").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).where((F.col("x.id") * 31 + F.col("y.id") * 17) % of < keep)
    kind = F.when(F.col("x.d") == F.col("y.d"), "semantic").when(F.abs(F.col("x.ts") - F.col("y.ts")) < day, "temporal").otherwise("associative")
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), kind.alias("link_type"))
