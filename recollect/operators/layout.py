"""Positions of memories for viewers, levels of detail, and representatives of clusters."""

from __future__ import annotations

from functools import reduce
from math import ceil, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import decay
from recollect.operators.stats import category
from recollect.plans.shared import stage

GOLDEN = pi * (3 - sqrt(5))
#: Memories shown at each level of detail, and the least camera distance for it.
DETAIL = ((50000, 0.0), (20000, 10.0), (8000, 25.0), (3000, 50.0), (1000, 100.0))


def numbered(df: DataFrame, order: str = "id") -> DataFrame:
    """df with i, its place from 0 in the order of a unique column, and n, the number of rows.

    Rows are range-partitioned and counted within their parts, which are then offset: no task sees all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_ = stage(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))  # a row for each part
    w = Window.orderBy("__part")
    sizes = sizes.withColumns({"__base": F.sum("__size").over(w) - F.col("__size"), "n": F.sum("__size").over(Window.partitionBy())})
    own = sorted_.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return own.withColumn("i", at + F.col("__base")).select(*df.columns, "i", "n")


def _domains(memories: DataFrame) -> DataFrame:
    """(domain, k, d): first tags in order, numbered from 0, and how many. First tags are a small vocabulary."""
    d = memories.select(category().alias("domain")).distinct()
    return d.withColumns({"k": F.row_number().over(Window.orderBy("domain")) - 1, "d": F.count("*").over(Window.partitionBy())})


def sphere(memories: DataFrame, radius: float = 10.0) -> DataFrame:
    """(id, x, y, z): a golden spiral on a sphere in the order of ids, each domain moved aside."""
    own = numbered(memories.select("id", category().alias("domain"))).join(_domains(memories), "domain")
    i = F.col("i") + 0.5
    theta, phi = F.acos(1 - 2 * i / F.col("n")), pi * (1 + sqrt(5)) * i
    turn = 2 * pi * F.col("k") / F.col("d")
    return own.select(
        "id",
        (radius * F.sin(theta) * F.cos(phi) + 3 * F.cos(turn)).alias("x"),
        (radius * F.sin(theta) * F.sin(phi) + 3 * F.sin(turn)).alias("y"),
        (radius * F.cos(theta) + (F.col("k") - F.col("d") / 2) * 0.5).alias("z"),
    )


def _even(low: float, high: float) -> Column:
    """The i-th of n evenly spaced values."""
    return F.when(F.col("n") == 1, F.lit(low)).otherwise(low + (high - low) * F.col("i") / (F.col("n") - 1))


def spiral(memories: DataFrame, as_of: int) -> DataFrame:
    """(id, x, y, z): a widening spiral in the order of ids, raised by age."""
    own = numbered(memories.select("id", ((F.lit(as_of) - F.col("ts")) / 3600.0).alias("age")))
    oldest = own.agg(F.max("age").alias("oldest"))
    turns = F.greatest(F.lit(3), F.floor(F.sqrt("n") / 5))
    share = F.when(F.col("n") == 1, 0.0).otherwise(F.col("i") / (F.col("n") - 1))
    t, r = share * turns * 2 * pi, _even(2.0, 15.0)
    up = F.when(F.col("oldest") > 0, F.col("age") / F.col("oldest") * 5).otherwise(0.0)
    return own.crossJoin(F.broadcast(oldest)).select("id", (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"), (_even(-8.0, 8.0) + up).alias("z"))


def grid(memories: DataFrame, spacing: float = 2.0) -> DataFrame:
    """(id, x, y, z): the smallest cube of grid points that holds all, in the order of ids."""
    own = numbered(memories.select("id")).withColumn("g", F.ceil(F.round(F.pow("n", F.lit(1 / 3)), 9)))
    half = F.col("g") * spacing / 2
    return own.select("id", *[(F.expr(e) * spacing - half).alias(c) for c, e in (("x", "i div (g * g)"), ("y", "(i div g) % g"), ("z", "i % g"))])


def binary_tree(memories: DataFrame) -> DataFrame:
    """(id, level, parent, x, y, z): a tree by place in the order of ids; parent is a place, null at the root."""
    own = numbered(memories.select("id"))
    deepest = F.least(F.lit(4), F.floor(F.log2("n")) + 1)
    own = own.withColumns({"levels": deepest, "level": F.least(F.floor(F.log2(F.col("i") + 1.0)), deepest - 1)})
    width = F.pow(F.lit(2.0), "level")
    turn = (F.col("i") - (width - 1)) / width * 2 * pi
    root = F.col("level") == 0
    return own.select(
        "id",
        F.col("level").cast("int").alias("level"),
        F.when(F.col("i") > 0, F.expr("(i - 1) div 2")).alias("parent"),
        F.when(root, 0.0).otherwise(F.col("level") * 1.5 * F.cos(turn)).alias("x"),
        F.when(root, 0.0).otherwise(F.col("level") * 1.5 * F.sin(turn)).alias("y"),
        F.when(root, 0.0).otherwise(2.0 * F.col("level") / F.col("levels")).alias("z"),
    )


def domain_levels(memories: DataFrame, most: int = 50) -> DataFrame:
    """(id, domain, place, level): of each domain the `most` most active, ten to a level, five levels."""
    own = memories.select("id", category().alias("domain"), "activation")
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("activation"), "id")) - 1
    return own.withColumn("place", place).where(F.col("place") < most).select("id", "domain", "place", F.least(F.lit(4), F.expr("place div 10")).alias("level"))


def freshness_hierarchy(memories: DataFrame) -> DataFrame:
    """(level, n, mean_activation): memories by freshness."""
    return memories.groupBy(decay.freshness_level(F.col("activation")).alias("level")).agg(F.count("*").alias("n"), F.avg("activation").alias("mean_activation"))


#: Where viewers put the memories of a domain; any other has no offset.
OFFSETS = {
    "nature": (-2, 2), "learning": (2, 2), "relationships": (-2, -2), "creativity": (2, -2), "artificial_intelligence": (3, 0), "computer_science": (2, 1),
    "biology": (-3, 0), "physics": (0, 3), "chemistry": (1, -3), "mathematics": (-1, 3), "literature": (-2, 1), "history": (1, 2), "psychology": (-1, -1), "philosophy": (0, -3),
}


def golden_levels(memories: DataFrame) -> DataFrame:
    """(id, level, x, y, z): each freshness level a golden-angle disc, most active in the middle."""
    own = memories.select("id", category().alias("domain"), "activation", decay.freshness_level(F.col("activation")).alias("level"))
    a, i = F.col("activation"), F.col("i")
    # places within a level: memories are few different activations, counted; only equal ones are ordered by id
    own = _ranked(own, "level")
    r, t = F.sqrt(i) * 0.5 + a * 0.3, i * GOLDEN
    at = F.create_map(*[x for k, (dx, dy) in OFFSETS.items() for x in (F.lit(k), F.struct(F.lit(float(dx)).alias("x"), F.lit(float(dy)).alias("y")))])
    off = lambda c: F.coalesce(at[F.col("domain")][c], F.lit(0.0))
    return own.select("id", "level", (r * F.cos(t) + off("x")).alias("x"), (r * F.sin(t) + off("y")).alias("y"), (F.col("level") * 2.0 + a * 0.5).alias("z"))


def _ranked(own: DataFrame, by: str) -> DataFrame:
    """own with i: the place from 0 within `by`, larger activation first, then id; partitioned by both, not by `by` alone."""
    sizes = own.groupBy(by, "activation").agg(F.count("*").alias("size"))
    w = Window.partitionBy(by).orderBy(F.desc("activation")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(by).alias("__by"), F.col("activation").alias("__a"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(by, "activation").orderBy("id")) - 1
    return own.withColumn("place", place).join(sizes, (F.col(by) == F.col("__by")) & (F.col("activation") == F.col("__a"))).withColumn("i", F.col("before") + F.col("place")).drop("__by", "__a", "before", "place")


def fractal(spark, levels: int) -> DataFrame:
    """(point, level, x, y, z): 4^level points on each level."""
    each = [spark.range(4**level).select((F.col("id") + (4**level - 1) // 3).alias("point"), F.lit(level).alias("level"), (F.col("id") / float(4**level) * 2 * pi).alias("t")) for level in range(levels)]
    p = reduce(DataFrame.unionByName, each)
    t, k = F.col("t"), F.col("level")
    noise = 0.2 * F.sin(t * (k + 1)) * F.cos(t * (k + 2))
    r = 1.0 + k * 0.8
    return p.select("point", "level", (r * F.cos(t) + noise).alias("x"), (r * F.sin(t) + noise).alias("y"), (k * 1.5 + 0.3 * F.sin(t * 3)).alias("z"))


def fractal_edges(points: DataFrame) -> DataFrame:
    """(a, b): every point with the first four of the next level."""
    first = F.expr("(bigint(pow(4, level + 1)) - 1) div 3")
    last = points.agg(F.max("level").alias("__last"))
    return points.crossJoin(F.broadcast(last)).where("level < __last").select(F.col("point").alias("a"), F.explode(F.sequence(first, first + 3)).alias("b"))


def branches(root: DataFrame, related: DataFrame, depth: int = 3, most: int = 8) -> DataFrame:
    """(id, level): related memories, in order of place, hung under a root: level k takes up to 2 + k branches (`most` at most) for each of the level before."""
    own = related.withColumns({"i": F.row_number().over(Window.orderBy("place"))})
    rows, begin, width = [], 1, 1
    for level in range(1, depth + 1):
        n = width * min(most, 2 + level)
        inside = F.col("i").between(begin, begin + n - 1)
        rows.append((inside, level))
        begin, width = begin + n, n
    level = F.lit(None).cast("int")
    for inside, k in rows:
        level = F.when(inside, k).otherwise(level)
    kept = own.withColumn("level", level).where("level is not null").select("id", "level")
    return root.select("id", F.lit(0).alias("level")).unionByName(kept)


def explorer(memories: DataFrame, limit: int = 20) -> DataFrame:
    """(id, place): the most active memory (place 0) and the first by id of those with its domain or one of its tags."""
    root = memories.select("id", "tags", "activation", category().alias("domain")).orderBy(F.desc("activation"), "id").limit(1)
    r = F.broadcast(root.select(F.col("id").alias("r"), F.col("tags").alias("rt"), F.col("domain").alias("rd")))
    near = memories.crossJoin(r).where((F.col("id") != F.col("r")) & ((category() == F.col("rd")) | F.arrays_overlap("tags", "rt"))).select("id").orderBy("id").limit(limit)
    return root.select("id", F.lit(0).alias("place")).unionByName(near.withColumn("place", F.row_number().over(Window.orderBy("id"))))


def detail_level(n: Column, distance: Column) -> Column:
    """The first level that holds n and isn't nearer than the camera; the coarsest if there is none."""
    out = F.lit(len(DETAIL) - 1)
    for k in range(len(DETAIL) - 1, -1, -1):
        out = F.when((n <= DETAIL[k][0]) & (distance >= DETAIL[k][1]), k).otherwise(out)
    return out


def features(memories: DataFrame, as_of: int) -> DataFrame:
    """(id, f): six numbers: hashes of domain and type, age, activation, version, length."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(1000)) / 1000.0
    f = F.array(part(category()), part(F.col("node_type")), (F.lit(as_of) - F.col("ts")) / 3600000.0, F.col("activation"), F.col("version") / 100.0, F.length("content") / 1000.0)
    return memories.select("id", f.alias("f"))


def _vectors(memories: DataFrame, as_of: int) -> DataFrame:
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    v = features(memories, as_of).select("id", array_to_vector("f").alias("raw"))
    return StandardScaler(inputCol="raw", outputCol="v", withMean=True).fit(v).transform(v).select("id", "v")


def principal(memories: DataFrame, as_of: int) -> DataFrame:
    """(id, x, y, z): the three principal components of the standardised features, times 10."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _vectors(memories, as_of)
    p = PCA(k=3, inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))
    return p.select("id", *[(F.col("p")[k] * 10).alias(c) for k, c in enumerate("xyz")])


def representatives(memories: DataFrame, as_of: int, k: int, seed: int = 42) -> DataFrame:
    """(cluster, id, n, activation, age_hours, versions, content, ids): k-means clusters of the features, each by its memory of the highest version.

    content is that of the first three, joined, up to 200 characters; ids are the first ten.
    """
    from pyspark.ml.clustering import KMeans

    v = _vectors(memories, as_of)
    c = stage(KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v).transform(v).select("id", "cluster"), "clusters")
    m = memories.join(c, "id")
    whole = m.groupBy("cluster").agg(
        F.max_by("id", F.struct("version", -F.col("id"))).alias("id"), F.count("*").alias("n"), F.avg("activation").alias("activation"),
        F.avg((F.lit(as_of) - F.col("ts")) / 3600.0).alias("age_hours"), F.sum("version").alias("versions"),
    )
    first = c.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where("place <= 10")
    first = memories.select("id", F.substring("content", 1, 201).alias("content")).join(F.broadcast(first), "id")  # ten rows a cluster
    kept = F.array_sort(F.collect_list(F.struct("place", "id", "content")))
    first = first.groupBy("cluster").agg(kept.alias("f")).select("cluster", F.array_join(F.slice(F.transform("f", lambda x: x["content"]), 1, 3), " | ").alias("content"), F.transform("f", lambda x: x["id"]).alias("ids"))
    short = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
    return whole.join(first, "cluster").withColumn("content", short)


def cube_side(n: int) -> int:
    return ceil(round(n ** (1 / 3), 9))
