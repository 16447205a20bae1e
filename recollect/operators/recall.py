"""Retrieval and ranking: tiers of content recall, the combined rank, tag, type and activation recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.fuzzy import best_ratio, partial_ratio
from recollect.plans.shared import stage

#: Digits to which scores are rounded before rows are ordered by them, so that ties are ties; these go by id.
DIGITS = 6
#: Which tiers a mode has. Later tiers only run while there are fewer results than asked for.
MODES = {"fast": (1,), "balanced": (1, 2), "comprehensive": (1, 2, 3, 4), "fuzzy": (4,)}


def top(df: DataFrame, score: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), "id").limit(k)


def _content(m: DataFrame) -> Column:
    return F.lower(m["content"])


def _tag_text(m: DataFrame) -> Column:
    return F.lower(F.array_join(m["tags"], " "))


def _share(terms, inside) -> Column:
    return T.hits(terms, inside) / max(1, len(terms))


def exact_score(m: DataFrame, q: T.Query) -> Column:
    content, tags = _content(m), _tag_text(m)
    return (
        F.when(content.contains(q.text), 0.4).otherwise(0.0)
        + 0.2 * _share(q.original, content.contains)
        + 0.3 * F.least(F.lit(1.0), m["activation"])
        + 0.1 * _share(q.original, tags.contains)
    )


def exact_tier(memories: DataFrame, q: T.Query, limit: int) -> DataFrame:
    """Tier 1: memories that have one of the query's terms among the tokens of their content and tags, best 2 * limit first.

    A scan with a filter: no index is built and nothing is shuffled but the best rows of each task.
    """
    low = F.lower(F.concat_ws(" ", memories["content"], F.array_join(memories["tags"], " ")))
    found = memories.where(T.hits(q.original, lambda t: T.has_token(low, t)) > 0)
    return top(found.withColumn("score", F.round(exact_score(found, q), DIGITS)), "score", 2 * limit)


def vocabulary_size(memories: DataFrame) -> int:
    """Distinct index terms and content words of all memories: a statistic of the store, of use to any number of queries."""
    own = memories.select(F.explode(F.array_union(T.index_terms(F.col("content")), T.content_words(F.col("content")))).alias("t"))
    return own.distinct().count()


def tfidf_tier(memories: DataFrame, q: T.Query, limit: int, idf_basis: str = "terms", exclude: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Tier 2: the sum of tf * ln(N / df) over the query's words; tf is 1 as token and 1 as word that isn't a stopword.

    N is the number of distinct terms, or of documents; n, where it is known, saves counting it. One scan finds the
    memories that have a term, of which (id, tf) is kept; from these come the document frequencies and the best rows, of
    which a second scan fetches the columns.
    """
    if idf_basis not in ("terms", "docs"):
        raise ValueError(f"idf_basis is terms or docs, not {idf_basis}")
    terms = q.processed or q.original
    low = F.lower("content")
    inside = [(T.has_token(low, t).cast("int") if len(t) > 2 else F.lit(0)) + (T.has_word(low, t).cast("int") if len(t) > 2 and t not in T.STOPWORDS else F.lit(0)) for t in terms]
    hit = reduce(lambda a, b: a | b, [low.contains(t) for t in terms], F.lit(False))
    rows = stage(memories.where(hit).select("id", F.array(*inside).alias("tf")), "terms") if terms else memories.select("id", F.array(F.lit(0)).alias("tf")).where("1 = 0")
    df = rows.agg(*[F.count_if(F.col("tf")[i] > 0).alias(f"d{i}") for i in range(len(terms))]).first() if terms else ()
    if n is None:
        n = memories.count() if idf_basis == "docs" else vocabulary_size(memories)
    score = reduce(lambda a, b: a + b, [F.when(F.col("tf")[i] > 0, F.col("tf")[i] * F.log(F.lit(n) / F.lit(df[i]))).otherwise(0.0) for i in range(len(terms)) if df[i]], F.lit(0.0))
    scored = rows.where(F.exists("tf", lambda x: x > 0)).select("id", F.round(score, DIGITS).alias("score"))
    if exclude is not None:
        scored = scored.join(exclude.select("id"), "id", "left_anti")
    best = top(scored, "score", limit)  # limit rows, so they may be broadcast
    return memories.join(F.broadcast(best), "id").select(*memories.columns, "score").orderBy(F.desc("score"), "id")


def phrase_score(m: DataFrame, q: T.Query) -> Column:
    return _share(q.phrases, _content(m).contains) if q.phrases else F.lit(0.0)


def phrase_tier(memories: DataFrame, q: T.Query, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """Tier 3: memories with one of the query's phrases as neighbouring tokens, by the share of phrases found in the content."""
    run = F.concat(F.lit(" "), F.array_join(T.tokens(memories["content"]), " "), F.lit(" "))
    found = memories.where(T.hits(q.phrases, lambda p: run.contains(f" {p} ")) > 0)
    if exclude is not None:
        found = found.join(exclude.select("id"), "id", "left_anti")
    return top(found.withColumn("score", F.round(phrase_score(found, q), DIGITS)), "score", limit)


def fuzzy_tier(memories: DataFrame, q: T.Query, limit: int, exclude: DataFrame | None = None, least: float = 60.0) -> DataFrame:
    """Tier 4: memories whose best of four fuzzy ratios with the query is above `least`, by ratio / 100 * (1 + activation)."""
    found = memories
    if exclude is not None:
        found = found.join(exclude.select("id"), "id", "left_anti")
    found = found.withColumn("__ratio", best_ratio(q.text)(_content(found))).where(F.col("__ratio") > least)
    return top(found.withColumn("score", F.round(F.col("__ratio") / 100 * (1 + F.col("activation")), DIGITS)).drop("__ratio"), "score", limit)


def recency(ts: Column, as_of: int) -> Column:
    days = F.floor((F.lit(as_of) - ts) / 86400.0)
    return F.greatest(F.lit(0.1), 0.9 * F.pow(F.lit(0.95), days) + 0.1)


def final_score(m: DataFrame, q: T.Query, as_of: int, mode: str, fuzzy: bool = False) -> Column:
    content = _content(m)
    bonus = F.when(content.contains(q.text), 0.5).otherwise(0.0)
    share = _share(q.terms, lambda t: T.has_word(content, t))
    near = partial_ratio(q.text)(content) / 100.0 if fuzzy and len(q.text) > 5 else F.lit(0.0)
    c = F.greatest(bonus + share * 0.7 + near * 0.3, bonus, share, near)
    a = F.least(F.lit(1.0), m["activation"])
    if mode == "fast":
        return 0.7 * c + 0.3 * a
    tags = _tag_text(m)
    rest = 0.2 * _share(q.terms, tags.contains) + 0.2 * a + 0.1 * recency(m["ts"], as_of)
    if mode == "balanced":
        return 0.5 * c + rest
    return 0.4 * c + rest + 0.1 * phrase_score(m, q)


def adaptive_threshold(q: T.Query, n: Column, context: str = "general", history: tuple[float, ...] = (), base: float = 0.1) -> Column:
    """Activation that a result needs, from the number of results, the words of the query, the context and earlier thresholds."""
    factor = 0.8 if q.n_words > 6 else 0.9 if q.n_words > 3 else 1.3 if q.n_words == 1 else 1.0
    factor *= {"precise": 1.4, "broad": 0.7}.get(context, 1.0)
    x = F.lit(base) * F.when(n < 3, 0.5).when(n > 30, 1.5).when(n > 15, 1.2).otherwise(1.0) * factor
    if len(history) > 5:
        x = (x + sum(history[-5:]) / 5) / 2
    return F.greatest(F.lit(0.01), F.least(F.lit(0.6), x))


def content_recall(memories: DataFrame, text: str, limit: int, as_of: int, mode: str = "balanced", fuzzy: bool = False, n_terms: int | None = None, context: str = "general", history: tuple[float, ...] = ()) -> DataFrame:
    """(memories' columns, score): content recall over the tiers of a mode, ranked, cut by the adaptive threshold, best first.

    A tier runs only if those before found fewer than limit. Every tier keeps 2 * limit rows at most, which are written,
    so what is joined, counted and broadcast between tiers is bounded by the query, not by the table. fuzzy=False leaves
    tier 4 out. n_terms: vocabulary_size, where it is known.
    """
    q = T.query(text)
    run = {
        1: lambda seen: exact_tier(memories, q, limit),
        2: lambda seen: tfidf_tier(memories, q, limit, exclude=seen, n=n_terms),
        3: lambda seen: phrase_tier(memories, q, limit, exclude=seen),
        4: lambda seen: fuzzy_tier(memories, q, limit, exclude=seen),
    }
    found, n = None, 0
    for tier in MODES[mode]:
        if tier == 4 and not fuzzy or tier == 3 and not q.phrases or n >= limit:
            continue
        more = stage(run[tier](F.broadcast(found) if found is not None else None), f"tier-{tier}")
        found = more if found is None else found.unionByName(more)
        n += more.count()
    if found is None:
        return memories.withColumn("score", F.lit(0.0)).where("1 = 0")
    found = found.withColumn("score", F.round(final_score(found, q, as_of, mode, fuzzy), DIGITS))
    kept = found.where(F.col("activation") >= adaptive_threshold(q, F.lit(n), context, history))
    return top(kept, "score", limit)


def tag_recall_any(memories: DataFrame, tags: list[str], limit: int) -> DataFrame:
    """Memories with any of the tags, by 10 * matches / number of tags asked for * (1 + activation). A tag asked for twice counts twice."""
    want = [t.strip().lower() for t in tags]
    own = F.transform("tags", lambda x: F.lower(F.trim(x)))
    found = memories.where(F.arrays_overlap(own, T.strings(want)))
    score = 10.0 * T.hits(want, lambda t: F.array_contains(own, t)) / max(1, len(want)) * (1 + F.col("activation"))
    return top(found.withColumn("score", F.round(score, DIGITS)), "score", limit)


def tag_recall_all(memories: DataFrame, tags: list[str], limit: int) -> DataFrame:
    """Memories with all of the tags that occur anywhere, by activation; none where no tag is known."""
    want = sorted({t.lower() for t in tags})
    own = F.transform("tags", F.lower)
    known = memories.agg(*[F.coalesce(F.bool_or(F.array_contains(own, t)), F.lit(False)).alias(f"__k{i}") for i, t in enumerate(want)])
    met = reduce(lambda a, b: a & b, [~F.col(f"__k{i}") | F.array_contains(own, t) for i, t in enumerate(want)])
    some = reduce(lambda a, b: a | b, [F.col(f"__k{i}") for i in range(len(want))])
    found = memories.where(F.arrays_overlap(own, T.strings(want))).crossJoin(F.broadcast(known)).where(met & some)
    return top(found.select(*memories.columns), "activation", limit)


def tags_match(memories: DataFrame, tags: list[str], match_all: bool = False) -> DataFrame:
    """Memories with any or all of the tags, whatever their case."""
    want, own = T.strings(sorted({t.lower() for t in tags})), F.transform("tags", F.lower)
    return memories.where(F.size(F.array_intersect(own, want)) == F.size(want) if match_all else F.arrays_overlap(own, want))


def top_activated(memories: DataFrame, limit: int) -> DataFrame:
    return top(memories, "activation", limit)


def by_type(memories: DataFrame, node_type: str, limit: int) -> DataFrame:
    return top(memories.where(F.col("node_type") == node_type), "activation", limit)


def by_activation(memories: DataFrame, least: float, limit: int = 100) -> DataFrame:
    return top(memories.where(F.col("activation") >= least), "activation", limit)


def recall(memories: DataFrame, text: str | None, tags: list[str] | None, limit: int, as_of: int) -> DataFrame:
    """Content recall for a text, else tag recall for tags, else what is most active."""
    if text:
        return content_recall(memories, text, limit, as_of)
    return tag_recall_any(memories, tags, limit) if tags else top_activated(memories, limit)


def read_boosts(results: DataFrame, as_of: int, boost: float = 0.03) -> DataFrame:
    """(id, ts_us, boost): the accesses that a recall leaves behind, one for each of its results."""
    return results.select("id", F.lit(as_of * 1_000_000).alias("ts_us"), F.lit(boost).alias("boost"))


def legacy_score(m: DataFrame, terms, as_of: int) -> Column:
    """Occurrences of the terms in the content, weighted by activation and age."""
    content = _content(m)
    n = reduce(lambda a, b: a + b, [(F.length(content) - F.length(F.replace(content, F.lit(t)))) / len(t) for t in terms])
    age = (F.lit(as_of) - m["ts"]) / 86400.0
    return n * (1 + m["activation"]) * F.greatest(F.lit(0.5), 1 - age / 365.0)


def word_hits(memories: DataFrame, want: list[str]) -> DataFrame:
    """(id, n): how many of the words, repeats counted, a memory has, if any. What has none is left out before the words are looked for closely."""
    low = F.lower("content")
    some = reduce(lambda a, b: a | b, [low.contains(t) for t in {*want}], F.lit(False))
    return memories.where(some).select("id", T.hits(want, lambda t: T.has_word(low, t)).alias("n")).where("n > 0")


def seeds(memories: DataFrame, text: str) -> DataFrame:
    """(id, a): the share of the query's words, repeats counted, that a memory has; in proportion to the largest share."""
    want = [w for w in T.re.findall(r"\b\w+\b", text.lower())]
    found = stage(word_hits(memories, want), "hits")
    best = found.agg(F.max("n").alias("best"))
    return found.crossJoin(F.broadcast(best)).select("id", (F.col("n") / F.col("best")).alias("a"))


def trigger_recall(memories: DataFrame, links: DataFrame, text: str, limit: int, boost: float = 0.5) -> DataFrame:
    """(id, a): seeds of a text and what first-visit spreading adds, over memories that exist, best first."""
    from recollect.operators.graph import spread_first

    spread = spread_first(stage(seeds(memories, text), "seeds"), memories, links, boost=boost)
    found = spread.join(memories.select("id"), "id", "left_semi").withColumn("a", F.round("a", DIGITS))
    return top(found, "a", limit)


def explore(memories: DataFrame, text: str, domains: list[str]) -> DataFrame:
    """Memories whose content, domain or any tag has the text in it, whatever its case."""
    low = text.lower()
    return memories.where(_content(memories).contains(low) | domain("tags", domains).contains(low) | F.exists("tags", lambda t: F.lower(t).contains(low)))


def domain(tags: str, domains: list[str]) -> Column:
    """The first tag that is a known domain, else general."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t.isin(*domains)), F.lit(1)), F.lit("general"))


def induced(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Links of which both ends are among the memories."""
    ids = memories.select("id")
    inside = links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return inside.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*links.columns)


def quality(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query, precision, recall, f1, passed): results (query, id) against relevant (query, id); each pair counts once."""
    r, t = results.select("query", "id").distinct(), relevant.select("query", "id").distinct()
    both = r.withColumn("got", F.lit(1)).join(t.withColumn("want", F.lit(1)), ["query", "id"], "full")
    n = both.groupBy("query").agg(F.sum(F.col("got") * F.col("want")).alias("hit"), F.sum("got").alias("got"), F.sum("want").alias("want"))
    hit = F.coalesce("hit", F.lit(0))
    p, c = F.coalesce(F.try_divide(hit, F.col("got")), F.lit(0.0)), F.coalesce(F.try_divide(hit, F.col("want")), F.lit(0.0))
    n = n.select("query", p.alias("precision"), c.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.withColumn("f1", f1).withColumn("passed", F.col("f1") > 0.5)


def quality_summary(q: DataFrame) -> DataFrame:
    """(queries, precision, recall, f1, f1_deviation, pass_rate) over all queries of quality; no deviation for a single one."""
    return q.agg(
        F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.stddev_samp("f1").alias("f1_deviation"), F.avg(F.col("passed").cast("int")).alias("pass_rate"),
    )
