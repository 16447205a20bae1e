"""Statistics of the store, of its links, and of what viewers and dashboards show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import decay, text


def store(memories: DataFrame, links: DataFrame, active: float = 0.1) -> DataFrame:
    """One row: memories, active ones, mean activation, different tags, links."""
    m = memories.agg(F.count("*").alias("total"), F.count_if(F.col("activation") > active).alias("active"), F.coalesce(F.avg("activation"), F.lit(0.0)).alias("mean_activation"))
    tags = memories.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("tags"))
    return m.crossJoin(tags).crossJoin(links.agg(F.count("*").alias("links")))


def ram(memories: DataFrame, capacity: int, threshold: float = 0.01) -> DataFrame:
    """One row: memories, active ones, mean activation, different words and lower-cased tags, percent of the capacity in use."""
    m = memories.agg(F.count("*").alias("total"), F.count_if(F.col("activation") > threshold).alias("active"), F.coalesce(F.avg("activation"), F.lit(0.0)).alias("mean_activation"))
    words = memories.select(F.explode(F.array_distinct(text.words(F.col("content")))).alias("w")).agg(F.count_distinct("w").alias("words"))
    tags = memories.select(F.explode(F.transform("tags", F.lower)).alias("t")).agg(F.count_distinct("t").alias("tags"))
    return m.crossJoin(words).crossJoin(tags).withColumn("usage_percent", F.col("total") * 100.0 / capacity)


def links(memories: DataFrame, links_: DataFrame) -> DataFrame:
    """One row: memories, links, links a memory, density, mean weight; 0 where there is nothing to divide by."""
    n, k = F.col("memories"), F.col("links")
    one = memories.agg(F.count("*").alias("memories")).crossJoin(links_.agg(F.count("*").alias("links"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("mean_weight")))
    zero = F.lit(0.0)
    return one.withColumns({"links_per_memory": F.coalesce(F.try_divide(k, n), zero), "density": F.coalesce(F.try_divide(k, n * (n - 1)), zero)})


def shares(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def tag_counts(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(memories: DataFrame, k: int = 10) -> DataFrame:
    return tag_counts(memories).orderBy(F.desc("n"), "tag").limit(k)


def category() -> Column:
    """The first tag."""
    return F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("uncategorized"))


def histogram(memories: DataFrame) -> DataFrame:
    """(bucket, n): memories by tens of percent of activation."""
    return memories.groupBy((F.floor(F.round(F.col("activation") * 10, 9)) * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def clusters(memories: DataFrame, least: int = 2) -> DataFrame:
    """(category, node_type, n, mean_activation): groups by first tag and type with `least` members or more."""
    g = memories.groupBy(category().alias("category"), "node_type").agg(F.count("*").alias("n"), F.avg("activation").alias("mean_activation"))
    return g.where(F.col("n") >= least)


def dashboard(memories: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n, total, mean_freshness, domains): the histogram of activation in equal bins from 0 to 1, with the totals beside it."""
    total = memories.agg(F.count("*").alias("total"), F.avg("activation").alias("mean_freshness"), F.count_distinct(category()).alias("domains"))
    at = F.least(F.lit(bins - 1), F.floor(F.round(F.col("activation") * bins, 9))).cast("int")
    return memories.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


def by_type_and_age(memories: DataFrame) -> DataFrame:
    """(node_type, age_level, n, mean_decay, mean_activation): as generated by type and position, position being the id."""
    i = F.col("id")
    g = memories.groupBy("node_type", decay.age_level(i).alias("age_level"))
    return g.agg(F.count("*").alias("n"), F.avg(decay.generated_decay(F.col("node_type"), i)).alias("mean_decay"), F.avg(decay.generated_activation(F.col("node_type"), i)).alias("mean_activation"))


def operations(log: DataFrame, name: str, value: str) -> DataFrame:
    """(name, n, total, mean, low, high) of a log of measurements."""
    return log.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def running(log: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """log with the mean, least and greatest value so far of each group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({"mean_so_far": F.avg(value).over(w), "best_so_far": F.min(value).over(w), "worst_so_far": F.max(value).over(w)})


def searches(log: DataFrame) -> DataFrame:
    """(tier, n, mean, best, worst) of a log of searches (tier, ms): how often each tier gave the result, and how long it took; a row with null tier for all."""
    return log.rollup("tier").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.min("ms").alias("best"), F.max("ms").alias("worst"))


def performance(log: DataFrame, baseline: str) -> DataFrame:
    """(operation, n, seconds, rate, speedup) of a log (operation, seconds): calls a second, and how many times that of the operation named as baseline."""
    g = log.groupBy("operation").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds")).withColumn("rate", F.try_divide(F.col("n"), F.col("seconds")))
    base = g.where(F.col("operation") == baseline).select(F.col("rate").alias("base"))  # one row
    return g.join(F.broadcast(base), how="left").select("operation", "n", "seconds", "rate", F.try_divide(F.col("rate"), F.col("base")).alias("speedup"))


def evictable(memories: DataFrame, threshold: float = 0.01, share: int = 10) -> DataFrame:
    """(id): of the least active tenth (one at least) those below the threshold.

    The tenth is cut by its activation, found from counts by value; only memories at that very value are ordered.
    """
    size = memories.groupBy("activation").agg(F.count("*").alias("n"))
    total = memories.agg(F.greatest(F.lit(1), F.expr(f"count(*) div {share}")).alias("most"))
    low = size.where(F.col("activation") < threshold).crossJoin(F.broadcast(total))
    before = F.coalesce(F.sum("n").over(Window.orderBy("activation").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = low.withColumn("room", F.col("most") - before).where("room > 0").select(F.col("activation").alias("__a"), "room", "n")
    own = memories.where(F.col("activation") < threshold).join(cut, F.col("activation") == F.col("__a"))
    whole = own.where("n <= room").select("id")
    edge = own.where("n > room").withColumn("place", F.row_number().over(Window.partitionBy("activation").orderBy("id"))).where("place <= room").select("id")
    return whole.unionByName(edge)


def fold(memories: DataFrame, accesses: DataFrame, as_of: int) -> DataFrame:
    """(id, activation, n): every memory's activation after decaying between its accesses, each of which boosts it, and up to as_of.

    Decay and boost are maps a -> p * a + q, so the whole is a0 * prod(p) + sum(q * product of the p that follow): a
    running sum over the accesses in order, which spills, and no list of them. The floor of single decays isn't applied.
    """
    m = memories.select("id", "activation", "decay_rate", "ts")
    own = accesses.join(m.select("id", "decay_rate", "ts"), "id").where(F.col("ts_us") >= F.col("ts") * 1000000).where(F.col("ts_us") <= as_of * 1000000)
    order = Window.partitionBy("id").orderBy("ts_us", "event_id")
    since = (F.col("ts_us") - F.coalesce(F.lag("ts_us").over(order), F.col("ts") * 1000000)) / 1000000.0
    own = own.withColumn("log_p", F.log(1 - F.col("boost")) - F.col("decay_rate") * since)
    after = F.coalesce(F.sum("log_p").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    own = own.withColumn("q", F.col("boost") * F.exp(after))
    own = own.groupBy("id").agg(F.sum("log_p").alias("log_p"), F.sum("q").alias("q"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    last = F.coalesce(F.col("last_us") / 1000000.0, F.col("ts").cast("double"))
    a = (F.col("activation") * F.exp(F.coalesce("log_p", F.lit(0.0))) + F.coalesce("q", F.lit(0.0))) * F.exp(-F.col("decay_rate") * F.greatest(F.lit(0.0), F.lit(as_of) - last))
    return m.join(own, "id", "left").select("id", F.least(F.lit(1.0), a).alias("activation"), F.coalesce("n", F.lit(0)).alias("n"))
