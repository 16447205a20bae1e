"""Mixing sources to target weights by Pareto order sampling (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.plans.shared import join_sized, stage, unused

#: Intervals of rank odds in which rows are counted to find a source's threshold; only rows of the threshold's own interval are sorted.
INTERVALS = 4096


def sampled(docs: DataFrame, weights: dict[str | None, int] | None = None, rows: int | None = None, seed: int = 1) -> DataFrame:
    """docs with a further column, last, of how many copies (1 or more) are drawn of a row, for the rows that are drawn.

    The column's name is `copies`, with underscores before it if docs has such a column. The mix has `rows` rows (default:
    as many as docs). Each source gets its share by largest remainders, after `weights` (whole numbers; a source that isn't
    named gets nothing) or, without them, the square root of its number of rows. Within a source a row's expected copies
    are in proportion to the number of binary digits of its text's length. The whole part is allocated for certain. For the
    fraction p the rows are ranked by u/(1-u) / (p/(1-p)), u being uniform by the MD5 of seed and doc_id, and the first m
    are drawn, m being what the source still lacks: the size is exact. Null is a source like any other; a null or empty
    text counts as length 0. Rows that repeat a doc_id have the same u; where they tie they are drawn in the order of a
    hash of all their columns (but for maps). An empty table, or no weight at all, gives no rows. docs may have any
    columns, whatever their names.
    """
    if weights is not None and any(w < 0 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers from 0")
    size_of = F.length(F.bin(F.coalesce(F.length("text"), F.lit(0)).cast("long"))).cast("long")
    size = stage(docs.select(F.col("source").alias("source"), size_of.alias("x")).groupBy("source").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "sources")
    if weights is None:
        size = size.withColumn("w", F.floor(F.sqrt("n") * 100).cast("long"))
    else:
        named = F.lit(0)
        for name, w in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(name)), int(w)).otherwise(named)
        size = size.withColumn("w", named.cast("long"))
    all_rows = Window.partitionBy()
    want = F.sum("n").over(all_rows) if rows is None else F.lit(int(rows)).cast("long")
    size = size.withColumns({"want": want, "all": F.sum("w").over(all_rows)}).where("all > 0")
    size = size.withColumns({"share": F.expr("want * w div all"), "over": F.expr("want * w % all")})
    size = size.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("over"), F.asc_nulls_first("source"))))
    lacking = F.col("want") - F.sum("share").over(all_rows)
    size = size.withColumn("share", F.col("share") + (F.col("rank") <= lacking).cast("long")).select("source", "share", "total")
    size = stage(size, "shares")

    # docs' own columns go in one, so that none of the names below can clash with them
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    plain = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), size_of.alias("x"), u.alias("u"), F.xxhash64(*plain).alias("tie"))
    d = join_sized(d, size, d["of"].eqNullSafe(size["source"]), "inner", 64).drop("of")
    d = d.withColumns({"whole": F.expr("share * x div total"), "rest": F.expr("share * x % total")})
    d = d.withColumn("odds", F.when(F.col("rest") > 0, F.expr("(u * (total - rest)) / ((1 - u) * rest)")))
    d = d.withColumn("at", F.floor(F.col("odds") / (F.col("odds") + 1) * INTERVALS).cast("int"))

    counts = stage(d.groupBy("source", "at").agg(F.count("odds").alias("n"), F.sum("whole").alias("whole"), F.first("share").alias("share")), "intervals")
    ordered = Window.partitionBy("source").orderBy(F.asc_nulls_first("at"))
    need = F.col("share") - F.sum("whole").over(Window.partitionBy("source"))
    reach = counts.withColumns({"need": need, "upto": F.sum("n").over(ordered)})
    cut = reach.where("at is not null and upto >= need and need > 0").groupBy("source").agg(F.min(F.struct("at", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("c"))
    cut = stage(cut.select(F.col("source").alias("cut_source"), F.col("c.at").alias("cut"), F.col("c.left").alias("left")), "cuts")
    d = join_sized(d, cut, d["source"].eqNullSafe(cut["cut_source"]), "left", 64)
    edge = F.coalesce(F.col("at") == F.col("cut"), F.lit(False))
    clear = d.where(~edge).withColumn("copies", F.col("whole") + F.coalesce(F.col("at") < F.col("cut"), F.lit(False)).cast("long"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("odds", "row.doc_id", "tie"))
    close = d.where(edge).withColumn("copies", F.col("whole") + (place <= F.col("left")).cast("long"))
    drawn = clear.unionByName(close).where("copies > 0")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("copies").cast("int").alias(unused("copies", docs)))


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, rows: int | None = None, seed: int = 1) -> DataFrame:
    """The columns of docs, each drawn row as often as it has copies; see sampled."""
    drawn = sampled(docs, weights, rows, seed)
    copies = drawn.columns[-1]
    each = unused("copy", drawn)
    return drawn.withColumn(each, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
