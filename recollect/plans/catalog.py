"""Registered queries over the memory store, each over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import decay as D
from recollect.functions import records
from recollect.functions import text as T
from recollect.operators import graph, layout, recall, sharding, stats, versions
from recollect.sources import store
from recollect.sources.tables import AS_OF, SQL_ACCESSES, SQL_LINKS, SQL_MEMORIES, accesses, links, memories, micros, read
from recollect.streaming import accesses as streams

QUERIES: dict = {}
ORACLES: dict = {}

#: What the registered queries ask for.
TEXT, TAGS, DOMAINS, START, LIMIT = "sich auf orantion", ["EN", "src3"], ["en", "de", "fr", "es"], 7, 20
SHARDS = ["shard000", "shard001", "shard002", "shard003"]
_DOMAIN = "CASE WHEN list_contains(['en','de','fr','es'], tags[1]) THEN tags[1] WHEN list_contains(['en','de','fr','es'], tags[2]) THEN tags[2] WHEN list_contains(['en','de','fr','es'], tags[3]) THEN tags[3] ELSE 'general' END"


def _rows(df: DataFrame, **rounded: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else df


def register(sql: str | None = None, tables: str = "m"):
    """Make a function (memories, links, accesses as `tables` has m, l, a) a query under its name. sql goes behind WITH and those tables."""

    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = {"m": memories, "l": links, "a": accesses}
            return f(*[made[t](spark, sf_dir) for t in tables])

        QUERIES[f.__name__] = query
        if sql:
            withs = {"m": SQL_MEMORIES, "l": SQL_LINKS, "a": SQL_ACCESSES}
            more = sql.strip()
            recursive = more.startswith("RECURSIVE")
            more = more.removeprefix("RECURSIVE").strip()
            ctes = ",\n".join(withs[t] for t in tables)
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{',' if not more.upper().startswith('SELECT') else ''}\n{more}"
        return f

    return add


# ---- content recall

_CONTENT = "lower(content)"
_TOKENS = "list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda t: t <> '')"
_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')"
_Q = T.query(TEXT)
_STOP = "[" + ",".join(f"'{w}'" for w in sorted(T.STOPWORDS)) + "]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")" if parts else "0"


def _has(text_sql: str, terms) -> str:
    return _sum([f"(contains({text_sql}, '{t}'))::INT" for t in terms])


_TAGTEXT = "lower(array_to_string(tags, ' '))"
_EXACT = f"""tier1 AS (
  SELECT m.*, round(CASE WHEN contains({_CONTENT}, '{_Q.text}') THEN 0.4 ELSE 0 END::DOUBLE + 0.2::DOUBLE * ({_has(_CONTENT, _Q.original)} / {len(_Q.original)}.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, activation)
         + 0.1::DOUBLE * ({_has(_TAGTEXT, _Q.original)} / {len(_Q.original)}.0::DOUBLE), 6) AS score
  FROM memories m
  WHERE list_has_any(list_filter(regexp_split_to_array(lower(content || ' ' || array_to_string(tags, ' ')), '\\s+'), lambda t: length(t) > 2), {_list(_Q.original)})
  ORDER BY score DESC, id LIMIT {2 * LIMIT})"""


@register(f"{_EXACT} SELECT id, score FROM tier1")
def exact_tier(m):
    return recall.exact_tier(m, _Q, LIMIT).select("id", "score")


def _tfidf(basis: str, without: str = "") -> str:
    terms = _Q.processed
    tf = [f"(list_contains(toks, '{t}'))::INT + (list_contains(wrds, '{t}'))::INT" for t in terms]
    every = "(SELECT count(DISTINCT t) FROM (SELECT unnest(list_distinct(list_concat(toks, wrds))) AS t FROM own))" if basis == "terms" else "(SELECT count(*) FROM own)"
    dfs = ", ".join(f"count(*) FILTER ({x} > 0) AS df{i}" for i, x in enumerate(tf))
    score = _sum([f"CASE WHEN tf{i} > 0 THEN tf{i} * ln({every} / df{i}) ELSE 0 END" for i in range(len(tf))])
    return f"""own AS (
  SELECT *, list_distinct(list_filter({_TOKENS}, lambda t: length(t) > 2)) AS toks,
         list_distinct(list_filter({_WORDS}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t))) AS wrds FROM memories
), freq AS (SELECT {dfs} FROM own),
counted AS (SELECT *, {", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))} FROM own),
tier2 AS (
  SELECT c.*, round({score}, 6) AS score FROM counted c, freq
  WHERE {_sum([f"tf{i}" for i in range(len(tf))])} > 0 {without} ORDER BY score DESC, id LIMIT {LIMIT})"""


@register(f"{_tfidf('terms')} SELECT id, score FROM tier2")
def tfidf_tier_terms(m):
    return recall.tfidf_tier(m, _Q, LIMIT).select("id", "score")


@register(f"{_tfidf('docs')} SELECT id, score FROM tier2")
def tfidf_tier_docs(m):
    return recall.tfidf_tier(m, _Q, LIMIT, "docs").select("id", "score")


_PHRASE_IN = _has(_CONTENT, _Q.phrases) + f" / {len(_Q.phrases)}.0::DOUBLE"
_PHRASES = f"""SELECT id, round({_PHRASE_IN}, 6) AS score FROM memories
WHERE {_has(f"' ' || array_to_string({_TOKENS}, ' ') || ' '", [f" {p} " for p in _Q.phrases])} > 0 ORDER BY score DESC, id LIMIT {LIMIT}"""


@register(_PHRASES)
def phrase_tier(m):
    return recall.phrase_tier(m, _Q, LIMIT).select("id", "score")


def _final(mode: str) -> str:
    share = _sum([f"(list_contains({_WORDS}, '{t}'))::INT" for t in _Q.terms]) + f" / {len(_Q.terms)}.0::DOUBLE"
    bonus = f"CASE WHEN contains({_CONTENT}, '{_Q.text}') THEN 0.5 ELSE 0 END::DOUBLE"
    c = f"greatest({bonus} + ({share}) * 0.7::DOUBLE, {bonus}, {share})"
    a = "least(1.0::DOUBLE, activation)"
    if mode == "fast":
        return f"0.7::DOUBLE * {c} + 0.3::DOUBLE * {a}"
    days = f"floor(({AS_OF} - ts) / 86400.0::DOUBLE)"
    rest = f"0.2::DOUBLE * ({_has(_TAGTEXT, _Q.terms)} / {len(_Q.terms)}.0::DOUBLE) + 0.2::DOUBLE * {a} + 0.1::DOUBLE * greatest(0.1::DOUBLE, 0.9::DOUBLE * power(0.95::DOUBLE, {days}) + 0.1::DOUBLE)"
    if mode == "balanced":
        return f"0.5::DOUBLE * {c} + {rest}"
    return f"0.4::DOUBLE * {c} + {rest} + 0.1::DOUBLE * ({_PHRASE_IN})"


_COLUMNS = "id, content, node_type, version, ts, activation, decay_rate, version_of, tags"
_FACTOR = 0.9 if _Q.n_words > 3 else 1.0


def _recall(mode: str) -> str:
    tiers, union = [_EXACT], f"SELECT {_COLUMNS} FROM tier1"
    if mode != "fast":
        tiers.append(_tfidf("terms", "AND c.id NOT IN (SELECT id FROM tier1)"))
        union += f" UNION ALL SELECT {_COLUMNS} FROM tier2 WHERE (SELECT count(*) FROM tier1) < {LIMIT}"
    tiers.append(f"found AS ({union})")
    if mode == "comprehensive":
        tiers[-1] = f"before3 AS ({union})"
        tiers.append(f"tier3 AS ({_PHRASES.replace('SELECT id,', 'SELECT ' + _COLUMNS + ',').replace('ORDER BY', 'AND id NOT IN (SELECT id FROM before3) ORDER BY')})")
        tiers.append(f"found AS (SELECT * FROM before3 UNION ALL SELECT {_COLUMNS} FROM tier3 WHERE (SELECT count(*) FROM before3) < {LIMIT})")
    n = "(SELECT count(*) FROM found)"
    threshold = f"greatest(0.01::DOUBLE, least(0.6::DOUBLE, 0.1::DOUBLE * CASE WHEN {n} < 3 THEN 0.5 WHEN {n} > 30 THEN 1.5 WHEN {n} > 15 THEN 1.2 ELSE 1.0 END::DOUBLE * {_FACTOR}::DOUBLE))"
    return ",\n".join(tiers) + f" SELECT id, round({_final(mode)}, 6) AS score FROM found WHERE activation >= {threshold} ORDER BY score DESC, id LIMIT {LIMIT}"


@register(_recall("fast"))
def content_recall_fast(m):
    return recall.content_recall(m, TEXT, LIMIT, AS_OF, "fast").select("id", "score")


@register(_recall("balanced"))
def content_recall_balanced(m):
    return recall.content_recall(m, TEXT, LIMIT, AS_OF, "balanced").select("id", "score")


@register(_recall("comprehensive"))
def content_recall_comprehensive(m):
    return recall.content_recall(m, TEXT, LIMIT, AS_OF, "comprehensive").select("id", "score")


@register()
def content_recall_fuzzy(m):
    return recall.content_recall(m, TEXT, LIMIT, AS_OF, "fuzzy", fuzzy=True).select("id", "score")


@register(f"SELECT id, round({_final('balanced')}, 6) AS score FROM memories")
def final_rank(m):
    return m.select("id", F.round(recall.final_score(m, _Q, AS_OF, "balanced"), 6).alias("score"))


@register(f"SELECT id, round(greatest(0.1::DOUBLE, 0.9::DOUBLE * power(0.95::DOUBLE, floor(({AS_OF} - ts) / 86400.0::DOUBLE)) + 0.1::DOUBLE), 6) AS score FROM memories")
def recency_score(m):
    return m.select("id", F.round(recall.recency(F.col("ts"), AS_OF), 6).alias("score"))


@register(
    f"SELECT id, round({_sum([f'(length({_CONTENT}) - length(replace({_CONTENT}, {chr(39)}{t}{chr(39)}, {chr(39)}{chr(39)}))) / {len(t)}.0::DOUBLE' for t in _Q.terms])}"
    f" * (1 + activation) * greatest(0.5::DOUBLE, 1 - ({AS_OF} - ts) / 86400.0::DOUBLE / 365.0::DOUBLE), 6) AS score FROM memories"
)
def legacy_content_score(m):
    return m.select("id", F.round(recall.legacy_score(m, _Q.terms, AS_OF), 6).alias("score"))


_SEEDS = f"""hits AS (SELECT id, {_sum([f"(list_contains({_WORDS}, '{t}'))::INT" for t in TEXT.split()])} AS n FROM memories),
seeds AS (SELECT id, n / (SELECT max(n) FROM hits)::DOUBLE AS a FROM hits WHERE n > 0)"""


@register(f"{_SEEDS} SELECT id, round(a, 6) AS a FROM seeds")
def seed_words(m):
    return _rows(recall.seeds(m, TEXT), a=6)


def _first_visit(starts: str, boost: float, hops: int = 3, links: str = "links") -> str:
    out, seen = [f"reach0 AS (SELECT id, a, [id::BIGINT] AS way FROM {starts})"], "SELECT id FROM reach0"
    for h in range(1, hops + 1):
        x = f"a * weight * {0.7**h!r}::DOUBLE"
        out.append(
            f"""reach{h} AS (SELECT id, x * {boost}::DOUBLE AS a, way FROM (
  SELECT to_id AS id, {x} AS x, list_append(way, pos::BIGINT) AS way FROM reach{h - 1} r JOIN {links} l ON from_id = r.id JOIN memories mm ON mm.id = r.id WHERE {x} > 0.01)
  WHERE id NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY way) = 1)"""
        )
        seen += f" UNION ALL SELECT id FROM reach{h}"
    out.append("spread AS (" + " UNION ALL ".join(f"SELECT id, a FROM reach{h}" for h in range(hops + 1)) + ")")
    return ",\n".join(out)


@register(f"{_SEEDS}, {_first_visit('seeds', 0.5)} SELECT id, round(a, 6) AS a FROM spread WHERE id IN (SELECT id FROM memories) ORDER BY round(a, 6) DESC, id LIMIT {LIMIT}", "ml")
def trigger_recall(m, l):
    return recall.trigger_recall(m, l, TEXT, LIMIT)


# ---- tags, types, activation

_LOWTAGS = "list_transform(tags, lambda t: lower(t))"


@register(f"""SELECT id, round(10.0::DOUBLE * ((list_contains({_LOWTAGS}, 'en'))::INT + (list_contains({_LOWTAGS}, 'src3'))::INT) / 2 * (1 + activation), 6) AS score
FROM memories WHERE list_has_any({_LOWTAGS}, ['en', 'src3']) ORDER BY score DESC, id LIMIT {LIMIT}""")
def tag_recall_or(m):
    return recall.tag_recall_any(m, TAGS, LIMIT).select("id", "score")


@register(f"SELECT id, round(activation, 6) AS activation FROM memories WHERE list_has_all({_LOWTAGS}, ['en', 'src3']) ORDER BY activation DESC, id LIMIT {LIMIT}")
def tag_recall_and(m):
    return _rows(recall.tag_recall_all(m, [*TAGS, "no such tag"], LIMIT).select("id", "activation"), activation=6)


@register(f"SELECT id, node_type FROM memories WHERE list_has_any({_LOWTAGS}, ['en', 'src3'])")
def tags_any(m):
    return recall.tags_match(m, TAGS).select("id", "node_type")


@register(f"SELECT id, node_type FROM memories WHERE list_has_all({_LOWTAGS}, ['en', 'src3'])")
def tags_all(m):
    return recall.tags_match(m, TAGS, True).select("id", "node_type")


@register(f"SELECT id, round(activation, 6) AS activation FROM memories ORDER BY activation DESC, id LIMIT {LIMIT}")
def top_activated(m):
    return _rows(recall.top_activated(m, LIMIT).select("id", "activation"), activation=6)


@register(f"SELECT id, round(activation, 6) AS activation FROM memories WHERE node_type = 'episodic' ORDER BY activation DESC, id LIMIT {LIMIT}")
def by_type(m):
    return _rows(recall.by_type(m, "episodic", LIMIT).select("id", "activation"), activation=6)


@register("SELECT id, round(activation, 6) AS activation FROM memories WHERE activation >= 0.7 ORDER BY activation DESC, id LIMIT 100")
def by_activation(m):
    return _rows(recall.by_activation(m, 0.7).select("id", "activation"), activation=6)


@register(f"SELECT id FROM memories WHERE contains({_CONTENT}, 'orantion') OR contains({_DOMAIN}, 'orantion') OR len(list_filter(tags, lambda t: contains(lower(t), 'orantion'))) > 0")
def explorer_search(m):
    return recall.explore(m, "Orantion", DOMAINS).select("id")


@register(f"SELECT id, {_DOMAIN} AS domain FROM memories")
def domains(m):
    return m.select("id", recall.domain("tags", DOMAINS).alias("domain"))


@register(f"kept AS (SELECT id FROM memories WHERE activation >= 0.6 AND {_DOMAIN} IN ('en', 'de')) SELECT from_id, to_id FROM links WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept)", "ml")
def induced_subgraph(m, l):
    kept = m.where((F.col("activation") >= 0.6) & recall.domain("tags", DOMAINS).isin("en", "de"))
    return recall.induced(kept, l).select("from_id", "to_id")


@register("best AS (SELECT id FROM memories ORDER BY activation DESC, id LIMIT 100) SELECT from_id, to_id FROM links WHERE from_id IN (SELECT id FROM best) AND to_id IN (SELECT id FROM best)", "ml")
def top_subgraph(m, l):
    return recall.induced(recall.top_activated(m.select("id", "activation"), 100), l).select("from_id", "to_id")


_HITS = " UNION ALL ".join(f"(SELECT '{d}' AS query, id FROM memories WHERE list_contains({_WORDS}, '{w}'))" for d, w in (("en", "the"), ("de", "der"), ("fr", "les"), ("es", "los")))


@register(f"""hit AS ({_HITS}), want AS (SELECT tags[1] AS query, id FROM memories),
n AS (SELECT w.query, (SELECT count(*) FROM hit h WHERE h.query = w.query) AS got, count(*) AS want, (SELECT count(*) FROM hit h JOIN want x ON h.query = x.query AND h.id = x.id WHERE h.query = w.query) AS hits FROM want w GROUP BY w.query)
SELECT query, round(hits / got, 6) AS precision, round(hits / want, 6) AS recall, round(2.0::DOUBLE * hits / (got + want), 6) AS f1, (2.0::DOUBLE * hits / (got + want)) > 0.5 AS passed FROM n""")
def retrieval_quality(m):
    """How well one frequent word of each language finds the memories of that language."""
    want = m.select(F.col("tags")[0].alias("query"), "id")
    pairs = F.array(*[F.when(T.has_word(F.lower("content"), w), F.lit(d)) for d, w in (("en", "the"), ("de", "der"), ("fr", "les"), ("es", "los"))])
    got = m.select(F.explode(F.array_compact(pairs)).alias("query"), "id")
    return _rows(recall.quality(got, want), precision=6, recall=6, f1=6)


# ---- statistics


@register("SELECT count(*) AS total, count(*) FILTER (activation > 0.1) AS active, round(avg(activation), 6) AS mean_activation, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM memories)) AS tags, (SELECT count(*) FROM links) AS links FROM memories", "ml")
def stats_memory(m, l):
    return _rows(stats.store(m, l), mean_activation=6)


@register(f"""SELECT count(*) AS total, count(*) FILTER (activation > 0.01) AS active, round(avg(activation), 6) AS mean_activation,
(SELECT count(DISTINCT w) FROM (SELECT unnest({_WORDS}) AS w FROM memories)) AS words, (SELECT count(DISTINCT t) FROM (SELECT unnest({_LOWTAGS}) AS t FROM memories)) AS tags,
round(count(*) * 100.0::DOUBLE / 100000, 6) AS usage_percent FROM memories""")
def stats_ram(m):
    return _rows(stats.ram(m, 100000), mean_activation=6, usage_percent=6)


@register("""n AS (SELECT count(*) AS memories FROM memories), k AS (SELECT count(*) AS links, avg(weight) AS w FROM links)
SELECT memories, links, round(w, 6) AS mean_weight, round(links / memories, 6) AS links_per_memory, round(links / (memories * (memories - 1)), 6) AS density FROM n, k""", "ml")
def stats_links(m, l):
    return _rows(stats.links(m, l), mean_weight=6, links_per_memory=6, density=6)


_ROOT = "chain AS (SELECT *, coalesce(version_of, id) AS root FROM memories)"


@register(f"""{_ROOT}, s AS (SELECT root, count(*) AS n FROM chain GROUP BY root)
SELECT (SELECT count(*) FROM memories) AS total, (SELECT count(*) FROM memories WHERE version_of IS NULL) AS roots, (SELECT count(*) FROM memories WHERE version_of IS NOT NULL) AS versioned,
count(*) FILTER (n > 1) AS chains, max(n) AS longest, round(avg(n) FILTER (n > 1), 6) AS mean_length, round((SELECT count(*) FROM memories WHERE version_of IS NOT NULL) / (SELECT count(*) FROM memories), 6) AS ratio FROM s""")
def stats_versions(m):
    return _rows(versions.statistics(m), mean_length=6, ratio=6)


@register("SELECT unnest(tags) AS tag, count(*) AS n FROM memories GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
def tag_frequency_top10(m):
    return stats.top_tags(m)


@register("SELECT tags[1] AS category, count(*) AS n FROM memories GROUP BY 1")
def category_counts(m):
    return stats.shares(m.select(stats.category().alias("category")), "category")


@register("SELECT node_type, count(*) AS n FROM memories GROUP BY 1")
def type_counts(m):
    return stats.shares(m, "node_type")


@register("SELECT CAST(floor(round(activation * 10, 9)) * 10 AS INTEGER) AS bucket, count(*) AS n FROM memories GROUP BY 1")
def decay_histogram(m):
    return stats.histogram(m)


@register("SELECT tags[1] AS category, node_type, count(*) AS n, round(avg(activation), 6) AS mean_activation FROM memories GROUP BY 1, 2 HAVING count(*) >= 2")
def cluster_groups(m):
    return _rows(stats.clusters(m), mean_activation=6)


@register("""SELECT CAST(least(19, floor(round(activation * 20, 9))) AS INTEGER) AS bin, count(*) AS n, (SELECT count(*) FROM memories) AS total,
(SELECT round(avg(activation), 6) FROM memories) AS mean_freshness, (SELECT count(DISTINCT tags[1]) FROM memories) AS domains FROM memories GROUP BY 1""")
def dashboard_metrics(m):
    return _rows(stats.dashboard(m), mean_freshness=6)


_AGES = "CASE WHEN id < 1000 THEN {0} WHEN id < 3000 THEN {1} WHEN id < 6000 THEN {2} WHEN id < 8000 THEN {3} ELSE {4} END"


def _age(field: int, quote: str = "", cast: str = "") -> str:
    return "(" + _AGES.format(*[f"{quote}{a[field]}{quote}" for a in D.AGES]) + f"){cast}"


_GEN_DECAY = f"greatest(0.005::DOUBLE, least(0.25::DOUBLE, CASE node_type WHEN 'episodic' THEN 0.08 WHEN 'fact' THEN 0.025 ELSE 0.04 END::DOUBLE * {_age(2, cast='::DOUBLE')}))"
_GEN_ACT = f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, CASE node_type WHEN 'episodic' THEN 0.8 WHEN 'fact' THEN 0.7 ELSE 0.7 END::DOUBLE + {_age(3, cast='::DOUBLE')}))"


@register(f"SELECT node_type, {_age(1, chr(39))} AS age_level, count(*) AS n, round(avg({_GEN_DECAY}), 6) AS mean_decay, round(avg({_GEN_ACT}), 6) AS mean_activation FROM memories GROUP BY 1, 2")
def decay_by_type_and_age(m):
    return _rows(stats.by_type_and_age(m), mean_decay=6, mean_activation=6)


@register("both_ways AS (SELECT from_id AS id, to_id AS other FROM links UNION SELECT to_id, from_id FROM links) SELECT id, count(*) AS degree, round(greatest(8, least(25, 8 + 2 * count(*)))::DOUBLE, 6) AS marker FROM both_ways GROUP BY id", "l")
def degree(l):
    return graph.degrees(l).withColumn("marker", F.greatest(F.lit(8.0), F.least(F.lit(25.0), 8.0 + 2 * F.col("degree"))))


@register("SELECT id AS name, count(*) AS n, round(sum(boost), 6) AS total, round(avg(boost), 6) AS mean, min(boost) AS low, max(boost) AS high FROM accesses GROUP BY id", "a")
def operation_stats(a):
    return _rows(stats.operations(a, "id", "boost"), total=6, mean=6)


@register("""SELECT event_id, round(avg(boost) OVER w, 9) AS mean_so_far, min(boost) OVER w AS best_so_far, max(boost) OVER w AS worst_so_far
FROM accesses WINDOW w AS (PARTITION BY id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)""", "a")
def running_stats(a):
    return _rows(stats.running(a, "id", ["ts_us", "event_id"], "boost").select("event_id", "mean_so_far", "best_so_far", "worst_so_far"), mean_so_far=9)


@register("""pairs AS (SELECT a.id, len(list_intersect(list_distinct(a.tags), list_distinct(b.tags))) AS common FROM memories a JOIN memories b ON a.id <> b.id)
SELECT id, count(*)::BIGINT AS n_edges, sum(common)::BIGINT AS weight FROM pairs WHERE common >= 2 GROUP BY id""")
def shared_tag_counts(m):
    return graph.shared_tags(m)


@register("""pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(list_distinct(a.tags), list_distinct(b.tags)))::BIGINT AS weight FROM memories a JOIN memories b ON a.id < b.id)
SELECT a, b, weight FROM pairs WHERE weight >= 2""")
def shared_tag_edges(m):
    return graph.shared_tag_edges(m)


# ---- links and traversals


@register("SELECT from_id, to_id, weight FROM links WHERE weight >= 0.5", "l")
def linked_nodes(l):
    return graph.linked(l, 0.5).select("from_id", "to_id", "weight")


@register("SELECT from_id, to_id, weight FROM links WHERE weight >= 0.3 AND to_id IN (SELECT id FROM memories)", "ml")
def related_nodes(m, l):
    return graph.related(l, m, 0.3).select("from_id", "to_id", "weight")


@register("SELECT a.id, b.id AS other, round(coalesce((SELECT max(weight) FROM links WHERE from_id = a.id AND to_id = b.id), 0), 6) AS weight FROM memories a JOIN memories b ON b.id = a.version_of", "ml")
def link_weights(m, l):
    """The weight of every memory's link to what it is a version of, 0 without one."""
    pairs = m.where("version_of is not null").join(m.select(F.col("id").alias("other")), F.col("version_of") == F.col("other")).select("id", "other")
    w = pairs.join(l, (pairs["id"] == l["from_id"]) & (pairs["other"] == l["to_id"]), "left")
    return w.select("id", "other", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


def _spread_sql(starts: str, depth: int) -> str:
    out, step = [f"f0 AS ({starts})"], []
    for d in range(1, depth + 1):
        out.append(f"s{d} AS (SELECT to_id AS id, a * weight * {0.7**d!r}::DOUBLE AS x FROM f{d - 1} f JOIN links ON from_id = f.id)")
        out.append(f"f{d} AS (SELECT id, max(x) AS a FROM s{d} WHERE x > 0.1 GROUP BY id)")
        step.append(f"SELECT * FROM s{d}")
    return ",\n".join(out) + ",\nspread AS (SELECT id, sum(x) AS score FROM (" + " UNION ALL ".join(step) + ") GROUP BY id)"


_STARTS = f"SELECT id, activation AS a FROM memories ORDER BY activation DESC, id LIMIT {LIMIT}"


def _starts(m: DataFrame) -> DataFrame:
    return recall.top_activated(m.select("id", "activation"), LIMIT).select("id", F.col("activation").alias("a"))


def _spread(depth: int):
    def f(m, l):
        return _rows(graph.spread_sum(_starts(m), l, depth), score=6)

    f.__name__ = f"spread_d{depth}"
    register(f"{_spread_sql(_STARTS, depth)} SELECT id, round(score, 6) AS score FROM spread", "ml")(f)


for _depth in (1, 2, 3):
    _spread(_depth)


def _max_sql(hops: int = 3) -> str:
    out = [f"g0 AS (SELECT id, 1.0::DOUBLE AS a FROM ({_STARTS}))"]
    for h in range(1, hops + 1):
        x = f"a * weight * {0.7**h!r}::DOUBLE"
        out.append(f"g{h} AS (SELECT id, max(a) AS a FROM (SELECT * FROM g{h - 1} UNION ALL SELECT to_id, {x} FROM g{h - 1} g JOIN links ON from_id = g.id WHERE {x} >= 0.01 AND to_id IN (SELECT id FROM memories) AND from_id IN (SELECT id FROM memories)) GROUP BY id)")
    return ",\n".join(out) + f" SELECT id, round(a, 6) AS a FROM g{hops} WHERE a >= 0.01"


@register(_max_sql(), "ml")
def spread_max(m, l):
    return _rows(graph.spread_max(_starts(m), m, l), a=6)


@register(f"{_first_visit(f'(SELECT id, 1.0::DOUBLE AS a FROM ({_STARTS}))', 1.0, 2)} SELECT id, round(a, 6) AS a FROM spread", "ml")
def spread_first(m, l):
    return _rows(graph.spread_first(_starts(m).withColumn("a", F.lit(1.0)), m, l, hops=2), a=6)


_FROM7 = f"SELECT {START}::BIGINT AS id, 1.0::DOUBLE AS a"


@register(f"{_spread_sql(_FROM7, 2)} SELECT s.id, round(score, 6) AS score, node_type FROM spread s JOIN memories m ON m.id = s.id WHERE s.id <> {START} ORDER BY round(score, 6) DESC, s.id LIMIT {LIMIT}", "ml")
def find_related_api(m, l):
    return recall.top(_rows(graph.find_related(m.sparkSession, m, l, START).select("id", "score", "node_type"), score=6), "score", LIMIT)


@register(f"{_spread_sql(_FROM7, 2)} SELECT s.id, round(activation, 6) AS activation FROM spread s JOIN memories m ON m.id = s.id WHERE s.id <> {START} ORDER BY activation DESC, s.id LIMIT {LIMIT}", "ml")
def find_related_engine(m, l):
    return recall.top(_rows(graph.find_related(m.sparkSession, m, l, START).select("id", "activation"), activation=6), "activation", LIMIT)


@register(f"""h0 AS (SELECT {START}::BIGINT AS id), h1 AS (SELECT DISTINCT to_id AS id FROM links WHERE from_id IN (SELECT id FROM h0) AND to_id NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT to_id AS id FROM links WHERE from_id IN (SELECT id FROM h1) AND to_id NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1))
SELECT id, 1 AS hops FROM h1 UNION ALL SELECT id, 2 FROM h2""", "ml")
def within_depth(m, l):
    return graph.within(m.where(F.col("id") == START).select("id"), l, m, 2)


@register("""edges AS (SELECT * FROM links WHERE weight >= 0.1), p0 AS (SELECT 7::BIGINT AS id, [7::BIGINT] AS path, []::STRUCT(w DOUBLE, id BIGINT)[] AS way),
p1 AS (SELECT to_id AS id, list_append(path, to_id) AS path, list_append(way, {'w': -weight, 'id': to_id}) AS way FROM p0 JOIN edges ON from_id = id WHERE to_id <> 7 QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY list_append(way, {'w': -weight, 'id': to_id})) = 1),
p2 AS (SELECT to_id AS id, list_append(path, to_id) AS path, list_append(way, {'w': -weight, 'id': to_id}) AS way FROM p1 JOIN edges ON from_id = id WHERE to_id <> 7 AND to_id NOT IN (SELECT id FROM p1) QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY list_append(way, {'w': -weight, 'id': to_id})) = 1),
p3 AS (SELECT to_id AS id, list_append(path, to_id) AS path, list_append(way, {'w': -weight, 'id': to_id}) AS way FROM p2 JOIN edges ON from_id = id WHERE to_id <> 7 AND to_id NOT IN (SELECT id FROM p1) AND to_id NOT IN (SELECT id FROM p2) QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY list_append(way, {'w': -weight, 'id': to_id})) = 1)
SELECT array_to_string(path, '>') AS path FROM (SELECT 1 AS h, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3) WHERE id = 0 ORDER BY h LIMIT 1""", "l")
def find_path(l):
    return graph.find_path(l.sparkSession, l, START, 0).select(F.array_join("path", ">").alias("path"))


@register("""RECURSIVE edges AS (SELECT DISTINCT from_id, to_id FROM links WHERE weight >= 0.5),
reach AS (SELECT from_id AS u, from_id AS v FROM edges UNION SELECT to_id, to_id FROM edges UNION SELECT u, to_id FROM reach JOIN edges ON v = from_id),
lowest AS (SELECT v AS id, min(u) AS component FROM reach GROUP BY v)
SELECT id, component FROM lowest WHERE component IN (SELECT component FROM lowest GROUP BY component HAVING count(*) > 1)""", "l")
def components(l):
    return graph.components(l)


@register("SELECT count(*) FILTER (weight < 0.1) AS pruned, count(*) FILTER (weight >= 0.1) AS kept FROM links", "l")
def prune_links_count(l):
    kept = graph.prune(l).agg(F.count("*").alias("kept"))
    return l.agg(F.count("*").alias("n")).crossJoin(kept).select((F.col("n") - F.col("kept")).alias("pruned"), "kept")


@register("""fresh AS (SELECT id AS from_id, version_of AS to_id, 0.95::DOUBLE AS weight, 'version' AS link_type FROM memories WHERE version_of IN (SELECT id FROM memories))
SELECT from_id, to_id, link_type, round(weight, 6) AS weight FROM fresh UNION ALL
SELECT from_id, to_id, link_type, round(weight, 6) FROM links l WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.from_id = l.from_id AND f.to_id = l.to_id AND f.link_type = l.link_type)""", "ml")
def link_upsert(m, l):
    new = m.where("version_of is not null").select(F.col("id").alias("from_id"), F.col("version_of").alias("to_id"), F.lit(0.95).alias("weight"), F.lit("version").alias("link_type"))
    return _rows(graph.upsert_links(l, new, m).select("from_id", "to_id", "link_type", "weight"), weight=6)


@register(f"""SELECT from_id, to_id, round(CASE WHEN from_id = {START} AND to_id = 5 AND pos = (SELECT min(pos) FROM links WHERE from_id = {START} AND to_id = 5) THEN 0.25 ELSE weight END::DOUBLE, 6) AS weight FROM links""", "l")
def link_set_weight(l):
    return _rows(graph.set_weight(l, START, 5, 0.25).select("from_id", "to_id", "weight"), weight=6)


# ---- decay

_AGE = f"({AS_OF} - ts)"
_DECAYED = {"exponential": f"activation * exp(-decay_rate * {_AGE})", "linear": f"greatest(0.0::DOUBLE, activation - decay_rate * {_AGE})", "power_law": f"activation * power(1 + {_AGE} / 3600.0::DOUBLE, -decay_rate)"}


def _seconds():
    return F.lit(AS_OF) - F.col("ts")


def _decay_queries(model: str) -> None:
    def f(m):
        return _rows(m.select("id", D.apply_decay(F.col("activation"), F.col("decay_rate"), _seconds(), model).alias("activation")), activation=6)

    f.__name__ = {"exponential": "decay_exp", "linear": "decay_linear", "power_law": "decay_power"}[model]
    register(f"SELECT id, round(CASE WHEN {_AGE} <= 0 THEN activation ELSE greatest(0.01::DOUBLE, {_DECAYED[model]}) END, 6) AS activation FROM memories")(f)


for _model in D.MODELS:
    _decay_queries(_model)


@register(f"SELECT id, round(activation - {_DECAYED['exponential']}, 6) AS lost FROM memories")
def decay_amount(m):
    return _rows(m.select("id", D.decay_amount(F.col("activation"), F.col("decay_rate"), _seconds()).alias("lost")), lost=6)


@register("SELECT id, round(least(1.0::DOUBLE, activation + (1 - activation) * 0.1::DOUBLE), 6) AS activation FROM memories")
def refresh(m):
    return _rows(m.select("id", D.boosted(F.col("activation"), 0.1).alias("activation")), activation=6)


@register("n AS (SELECT id, count(*) AS n FROM accesses GROUP BY id) SELECT m.id, n, round(1 - (1 - activation) * power(0.95::DOUBLE, n), 6) AS activation FROM memories m JOIN n ON m.id = n.id", "ma")
def n_boosts(m, a):
    n = a.groupBy("id").agg(F.count("*").alias("n"))
    return _rows(m.join(n, "id").select("id", "n", D.boosted(F.col("activation"), 0.05, F.col("n")).alias("activation")), activation=6)


@register("SELECT id, round(ln(activation / 0.01::DOUBLE) / decay_rate, 3) AS exponential, round((activation - 0.01::DOUBLE) / decay_rate, 3) AS linear FROM memories")
def forget_time(m):
    a, r = F.col("activation"), F.col("decay_rate")
    return _rows(m.select("id", D.forget_seconds(a, r).alias("exponential"), D.forget_seconds(a, r, "linear").alias("linear")), exponential=3, linear=3)


@register(f"SELECT id FROM memories WHERE {_DECAYED['exponential']} < 0.1")
def forgotten(m):
    return m.where(D.decayed(F.col("activation"), F.col("decay_rate"), _seconds()) < 0.1).select("id")


@register(f"SELECT count(*) AS n, count(*) FILTER ({_DECAYED['exponential']} > 0.1) AS active, round(avg(greatest(0.01::DOUBLE, {_DECAYED['exponential']})), 6) AS mean_activation FROM memories")
def global_decay(m):
    a = D.apply_decay(F.col("activation"), F.col("decay_rate"), _seconds())
    return _rows(m.select(a.alias("a")).agg(F.count("*").alias("n"), F.count_if(F.col("a") > 0.1).alias("active"), F.avg("a").alias("mean_activation")), mean_activation=6)


@register("SELECT id FROM (SELECT id, activation, row_number() OVER (ORDER BY activation, id) AS place FROM memories) WHERE activation < 0.5 AND place <= greatest(1, (SELECT count(*) // 10 FROM memories))")
def eviction(m):
    return stats.evictable(m, 0.5)


@register(f"""own AS (SELECT a.id, a.ts_us, a.event_id, a.boost, m.decay_rate, m.ts FROM accesses a JOIN memories m ON m.id = a.id WHERE a.ts_us BETWEEN m.ts * 1000000 AND {AS_OF * 1000000}),
p AS (SELECT *, ln(1 - boost) - decay_rate * (ts_us - coalesce(lag(ts_us) OVER (PARTITION BY id ORDER BY ts_us, event_id), ts * 1000000)) / 1000000.0::DOUBLE AS log_p FROM own),
q AS (SELECT *, coalesce(sum(log_p) OVER (PARTITION BY id ORDER BY ts_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM p),
f AS (SELECT id, sum(log_p) AS log_p, sum(boost * exp(later)) AS q, max(ts_us) AS last_us, count(*) AS n FROM q GROUP BY id)
SELECT m.id, round(least(1.0::DOUBLE, (activation * exp(coalesce(log_p, 0)) + coalesce(q, 0)) * exp(-decay_rate * greatest(0, {AS_OF} - coalesce(last_us / 1000000.0::DOUBLE, ts::DOUBLE)))), 6) AS activation, coalesce(n, 0) AS n
FROM memories m LEFT JOIN f ON m.id = f.id""", "ma")
def activation_fold(m, a):
    return _rows(stats.fold(m, a, AS_OF), activation=6)


_LEVEL = "CASE WHEN activation > 0.8 THEN 0 WHEN activation > 0.6 THEN 1 WHEN activation > 0.4 THEN 2 WHEN activation > 0.2 THEN 3 ELSE 4 END"


@register(f"""SELECT id, ['fresh','active','aging','old','fading'][{_LEVEL} + 1] AS band,
round([8 + activation * 12, 6 + activation * 10, 4 + activation * 8, 3 + activation * 6, 2 + activation * 4][{_LEVEL} + 1], 6) AS size, round(0.3::DOUBLE + activation * 0.7::DOUBLE, 6) AS opacity FROM memories""")
def freshness_band(m):
    a = F.col("activation")
    return _rows(m.select("id", D.freshness_band(a).alias("band"), D.marker_size(a).alias("size"), D.marker_opacity(a).alias("opacity")), size=6, opacity=6)


@register(f"SELECT id, round(least(1.0::DOUBLE, exp(-CASE node_type WHEN 'episodic' THEN 0.8 ELSE 0.5 END::DOUBLE * ({_AGE} / 3600.0::DOUBLE) / 24.0::DOUBLE)), 6) AS shown FROM memories")
def viewer_decay(m):
    return _rows(m.select("id", D.faded(F.col("node_type"), _seconds() / 3600.0).alias("shown")), shown=6)


@register(f"SELECT id, {_age(1, chr(39))} AS age_level, round({_GEN_DECAY}, 6) AS decay_rate, round({_GEN_ACT}, 6) AS activation FROM memories")
def generated_rates(m):
    i, k = F.col("id"), F.col("node_type")
    return _rows(m.select("id", D.age_level(i).alias("age_level"), D.generated_decay(k, i).alias("decay_rate"), D.generated_activation(k, i).alias("activation")), decay_rate=6, activation=6)


# ---- versions


@register(f"{_ROOT} SELECT id, root FROM chain")
def version_root(m):
    return versions.roots(m)


@register(f"{_ROOT} SELECT root, id, CAST(row_number() OVER (PARTITION BY root ORDER BY version, id) AS INTEGER) AS place FROM chain")
def version_chain(m):
    return versions.chains(m).select("root", "id", "place")


@register(f"{_ROOT} SELECT root, id, version FROM chain QUALIFY row_number() OVER (PARTITION BY root ORDER BY version DESC, id DESC) = 1")
def version_latest(m):
    return versions.latest(m)


@register("SELECT m.id, coalesce(m.version_of, m.id) AS original_id, r.version AS original_version FROM memories m JOIN memories r ON r.id = coalesce(m.version_of, m.id)")
def version_original(m):
    return versions.originals(m)


@register(f"{_ROOT} SELECT root, max(version) + 1 AS next_version FROM chain GROUP BY root")
def version_next(m):
    return versions.next_versions(m)


@register(f"""{_ROOT}, o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY version, id) AS place FROM chain),
t AS (SELECT root, tag, min(place * 10 + k) AS spot FROM (SELECT root, place, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM o) GROUP BY root, tag)
SELECT root, arg_max(id, place) AS id, CAST(count(*) AS INTEGER) AS version, round(max(activation), 6) AS activation, (SELECT string_agg(tag, ',' ORDER BY spot) FROM t WHERE t.root = o.root) AS tags FROM o GROUP BY root""")
def version_consolidate(m):
    return _rows(versions.consolidate(m).select("root", "id", "version", "activation", F.array_join("tags", ",").alias("tags")), activation=6)


@register(f"""{_ROOT}, o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY version, id) AS place FROM chain),
f AS (SELECT root, to_id, weight, link_type FROM links JOIN o ON from_id = o.id QUALIFY row_number() OVER (PARTITION BY root, to_id ORDER BY place, pos) = 1)
SELECT (SELECT arg_max(id, place) FROM o WHERE o.root = f.root) AS from_id, to_id, round(weight, 6) AS weight, link_type FROM f""", "ml")
def version_consolidate_links(m, l):
    return _rows(versions.consolidate_links(m, l), weight=6)


@register(f"{_ROOT} SELECT root, id FROM (SELECT root, id, activation, row_number() OVER (PARTITION BY root ORDER BY version DESC, id) AS n FROM chain) WHERE n > 2 AND activation < 0.5")
def version_prune(m):
    return versions.prunable(m, 2, 0.5)


# ---- shards


def _ring_sql(name: str, shards: list[str]) -> str:
    return f"{name} AS (SELECT md5(s || ':' || i) AS p, s FROM (SELECT unnest({_list(shards)}) AS s), range(100) t(i))"


def _at(name: str, key: str) -> str:
    first = f"SELECT s FROM {name} ORDER BY p LIMIT 1"
    return f"coalesce((SELECT arg_min(s, p) FROM {name} WHERE p >= md5({key}::VARCHAR)), ({first}))"


_SHARDED = f"{_ring_sql('ring', SHARDS)}, own AS (SELECT *, {_at('ring', 'id')} AS shard FROM memories)"


@register(f"{_SHARDED} SELECT id, shard FROM own")
def shard_assign(m):
    return sharding.assign(m.select("id"), "id", SHARDS)


@register(f"{_SHARDED} SELECT shard, count(*) AS n, count(*) FILTER (activation > 0.01) AS active, round(avg(activation), 6) AS mean_activation FROM own GROUP BY shard")
def stats_shards(m):
    return _rows(sharding.statistics(m, SHARDS), mean_activation=6)


@register(f"{_ring_sql('r1', SHARDS)}, {_ring_sql('r2', [*SHARDS, 'shard004'])}, b AS (SELECT id, {_at('r1', 'id')} AS old, {_at('r2', 'id')} AS new FROM memories) SELECT * FROM b WHERE old <> new")
def reshard_moves(m):
    return sharding.moves(m, "id", SHARDS, [*SHARDS, "shard004"])


@register(f"{_SHARDED} SELECT id, shard, round(activation, 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY activation DESC, id) AS place FROM own WHERE list_has_all({_LOWTAGS}, ['en', 'src3'])) WHERE place <= {2 * LIMIT} ORDER BY activation DESC, id LIMIT {LIMIT}")
def shard_search_tags(m):
    return _rows(sharding.search_tags(m, TAGS, SHARDS, LIMIT).select("id", "shard", "activation"), activation=6)


@register(f"""{_SHARDED}, hits AS (SELECT id, shard, {_sum([f"(list_contains({_WORDS}, '{t}'))::INT" for t in TEXT.split()])} AS n FROM own),
part AS (SELECT id, shard, round(n / (max(n) OVER (PARTITION BY shard))::DOUBLE, 6) AS a FROM hits WHERE n > 0)
SELECT id, shard, a FROM part QUALIFY row_number() OVER (PARTITION BY shard ORDER BY a DESC, id) <= {2 * LIMIT} ORDER BY a DESC, id LIMIT {LIMIT}""")
def shard_seed_words(m):
    return sharding.search_words(m, TEXT, SHARDS, LIMIT)


@register(f"""{_SHARDED}, hits AS (SELECT id, shard, {_sum([f"(list_contains({_WORDS}, '{t}'))::INT" for t in TEXT.split()])} AS n FROM own),
seeds AS (SELECT id, n / (max(n) OVER (PARTITION BY shard))::DOUBLE AS a FROM hits WHERE n > 0),
inside AS (SELECT l.* FROM links l JOIN own a ON a.id = l.from_id JOIN own b ON b.id = l.to_id WHERE a.shard = b.shard),
{_first_visit('seeds', 0.5, links='inside')},
part AS (SELECT s.id, o.shard, round(a, 6) AS a FROM spread s JOIN own o ON o.id = s.id)
SELECT id, shard, a FROM part QUALIFY row_number() OVER (PARTITION BY shard ORDER BY a DESC, id) <= {2 * LIMIT} ORDER BY a DESC, id LIMIT {LIMIT}""", "ml")
def shard_search(m, l):
    return sharding.search(m, l, TEXT, SHARDS, LIMIT)


@register(f"{_SHARDED} SELECT id, content, shard FROM own WHERE id IN (7, 42, 99)")
def shard_get(m):
    return sharding.routed(m, [7, 42, 99, 1 << 40], SHARDS).select("id", "content", "shard")


@register(f"{_SHARDED} SELECT id, CASE WHEN id % 10 = 0 THEN 'changed ' || content ELSE content END AS content, shard FROM own UNION ALL SELECT id + 1000000000, content, {_at('ring', '(id + 1000000000)')} FROM own WHERE id % 50 = 0")
def shard_upsert(m):
    changed = m.where("id % 10 = 0").withColumn("content", F.concat(F.lit("changed "), "content"))
    added = m.where("id % 50 = 0").withColumn("id", F.col("id") + 1000000000)
    return sharding.routed_upsert(m, changed.unionByName(added), SHARDS).select("id", "content", "shard")


# ---- text and records


@register("SELECT substr(sha256(content), 1, 16) AS hash, count(*) AS n, min(id) AS first_id FROM memories GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(m):
    return m.groupBy(T.content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


_NOTAGS = _list(sorted(T.NO_TAGS))


def _simple(most: int) -> str:
    return f"""placed AS (
  SELECT id, w, min(i) AS i FROM (
    SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT id, list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains({_NOTAGS}, w)) AS ws FROM memories))
  GROUP BY id, w
), firsts AS (SELECT id, list(w ORDER BY i)[1:{most}] AS t FROM placed GROUP BY id),
tagged AS (SELECT m.id, version_of, coalesce(t, []) AS t FROM memories m LEFT JOIN firsts f ON f.id = m.id)"""


@register(f"{_simple(10)} SELECT id, array_to_string(t, ',') AS tags FROM tagged")
def simple_tags(m):
    return m.select("id", F.array_join(T.simple_tags(F.col("content")), ",").alias("tags"))


_NAMES = "list_concat(list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')), regexp_extract_all(content, '#([\\p{L}\\p{N}_]+)', 1))"


@register(f"SELECT id, array_to_string(list_filter(names, lambda w, i: list_position(names, w) = i)[1:10], ',') AS tags FROM (SELECT id, {_NAMES} AS names FROM memories)")
def extract_tags(m):
    return m.select("id", F.array_join(T.name_tags(F.col("content")), ",").alias("tags"))


@register(f"""{_simple(50)}
SELECT a.id, b.id AS other, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END::DOUBLE, 6) AS similarity FROM tagged a JOIN tagged b ON b.id = a.version_of""")
def jaccard_pairs(m):
    """Every memory against the one that it is a version of."""
    t = m.select("id", "version_of", T.simple_tags(F.col("content"), 50).alias("t"))
    o = t.select(F.col("id").alias("other"), F.col("t").alias("t2"))
    return t.join(o, t["version_of"] == o["other"]).select("id", "other", F.round(T.jaccard(F.col("t"), F.col("t2")), 6).alias("similarity"))


@register("""SELECT id, CASE WHEN length(content) <= 100 THEN content ELSE
CASE WHEN contains(content[1:100], ' ') AND 100 - instr(reverse(content[1:100]), ' ') > 70 THEN substr(content, 1, 100 - instr(reverse(content[1:100]), ' ')) ELSE content[1:100] END || '...' END AS summary FROM memories""")
def summary(m):
    return m.select("id", T.summary(F.col("content")).alias("summary"))


_CLEAN = """regexp_replace(regexp_replace(regexp_replace(content, '[<>:"/\\\\|?*]', '_', 'g'), '[\\s_]+', '_', 'g'), '^_+|_+$', '', 'g')"""


@register(f"SELECT id, CASE WHEN c = '' THEN 'unnamed' WHEN length(c) > 100 THEN regexp_replace(substr(c, 1, 100), '_+$', '') ELSE c END AS name FROM (SELECT id, {_CLEAN} AS c FROM memories)")
def sanitize(m):
    return m.select("id", T.file_name(F.col("content")).alias("name"))


@register("""o AS (SELECT from_id, list(link_type) AS kinds FROM links GROUP BY from_id)
SELECT id, CAST(67 + strlen(node_type) + strlen(content) + CASE WHEN version_of IS NULL THEN 0 ELSE 36 END + list_sum(list_transform(tags, lambda t: 1 + strlen(t))) + coalesce(list_sum(list_transform(kinds, lambda t: 41 + strlen(t))), 0) AS INTEGER) AS bytes FROM memories LEFT JOIN o ON id = from_id""", "ml")
def node_size(m, l):
    kinds = l.groupBy("from_id").agg(F.collect_list("link_type").alias("kinds"))
    b = T.record_bytes(F.col("content"), F.col("node_type"), F.col("version_of"), F.col("tags"), F.col("kinds"))
    return m.join(kinds, m["id"] == kinds["from_id"], "left").select("id", b.cast("int").alias("bytes"))


@register("SELECT CASE WHEN strlen(content) < 1024 THEN 'lz4/1' WHEN strlen(content) < 10240 THEN 'zlib/5' ELSE 'blosc/9' END AS codec, count(*) AS n FROM memories GROUP BY 1")
def compression_choice(m):
    return m.groupBy(T.codec_for(F.octet_length("content")).alias("codec")).agg(F.count("*").alias("n"))


_CHUNKS = "pieces AS (SELECT id, k::INTEGER AS chunk_no, substr(content, k::INTEGER * 1000 + 1, 1000) AS chunk FROM memories, LATERAL (SELECT unnest(range(0, (greatest(length(content), 1) - 1) // 1000 + 1)) AS k))"


@register(f"{_CHUNKS} SELECT id, chunk_no, md5(chunk) AS chunk_md5 FROM pieces")
def chunks(m):
    return store.chunked(m, "id", "content").select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@register(f"{_CHUNKS} SELECT a.id, a.chunk_no AS from_no, b.chunk_no AS to_no FROM pieces a JOIN pieces b ON a.id = b.id AND b.chunk_no < a.chunk_no AND b.chunk_no >= a.chunk_no - 3")
def chunk_links(m):
    return store.chunk_links(store.chunked(m, "id", "content"), "id")


@register("""o AS (SELECT from_id, count(*) AS n FROM links GROUP BY from_id)
SELECT id, md5(content) AS content_md5, version, node_type, coalesce(n, 0) AS n_links FROM memories LEFT JOIN o ON id = from_id""", "ml")
def export_rows(m, l):
    """Exported JSON, read back."""
    row = F.from_json("row", "content string, version int, node_type string, links array<struct<to_id:bigint>>")
    return store.export_json(m, l).select("id", row.alias("r")).select("id", F.md5("r.content").alias("content_md5"), "r.version", "r.node_type", F.size("r.links").cast("long").alias("n_links"))


@register("SELECT id, round(greatest(activation, least(1.0::DOUBLE, activation + CASE WHEN node_type = 'task' THEN 0.05 ELSE -0.05 END::DOUBLE)), 6) AS activation, version + 1 AS version FROM memories")
def upsert_rows(m):
    """All memories rewritten with a changed activation; the larger one stays."""
    new = m.withColumns({"activation": F.least(F.lit(1.0), F.col("activation") + F.when(F.col("node_type") == "task", 0.05).otherwise(-0.05)), "version": F.col("version") + 1})
    return _rows(store.upsert(m, new).select("id", "activation", "version"), activation=6)


@register(f"SELECT id, ts FROM memories ORDER BY ts DESC, id DESC LIMIT {LIMIT}")
def warm_load(m):
    return store.newest(m, LIMIT).select("id", "ts")


@register(f"SELECT id, node_type, round(least(1.0::DOUBLE, d + (1 - d) * 0.05::DOUBLE), 6) AS activation FROM (SELECT *, greatest(0.01::DOUBLE, {_DECAYED['exponential']}) AS d FROM memories WHERE id = {START})")
def point_read(m):
    a = D.apply_decay(F.col("activation"), F.col("decay_rate"), _seconds())
    return _rows(store.point(m, START).select("id", "node_type", D.boosted(a, 0.05).alias("activation")), activation=6)


@register(f"""o AS (SELECT from_id, count(*) AS n, sum(weight) AS w FROM links GROUP BY from_id)
SELECT lpad(id::VARCHAR, 36, '0') AS id, md5(content) AS content_md5, version, array_to_string(tags, ',') AS tags, coalesce(n, 0) AS n_links, round(coalesce(w, 0), 3) AS weight, round(activation, 4) AS activation FROM memories LEFT JOIN o ON id = from_id""", "ml")
def record_round_trip(m, l):
    """All memories as binary records and back; the format keeps weights and activations in single precision."""
    back = records.decoded(records.encoded(records.as_records(m, l)))
    w = F.aggregate(F.transform("links", lambda x: x["weight"]), F.lit(0.0), lambda a, x: a + x)
    return _rows(back.select("id", F.md5("content").alias("content_md5"), "version", F.array_join("tags", ",").alias("tags"), F.size("links").cast("long").alias("n_links"), w.alias("weight"), "activation"), weight=3, activation=4)


@register()
def compression_savings(m):
    """Sizes by zlib level and by the codec that the size would get."""
    p = records.compressed(m, "id", "content").withColumn("codec", T.codec_for(F.col("bytes")))
    return p.groupBy("level", "codec").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("packed").alias("packed"))


@register(f"""d AS (SELECT id, ts, {_DOMAIN} AS d FROM memories)
SELECT from_id, to_id, round(weight, 6) AS weight, CASE WHEN a.d = b.d THEN 'semantic' WHEN abs(a.ts - b.ts) < 86400 THEN 'temporal' ELSE 'associative' END AS link_type FROM links JOIN d a ON a.id = from_id JOIN d b ON b.id = to_id""", "ml")
def link_types(m, l):
    return _rows(graph.typed(l, m, recall.domain("tags", DOMAINS)), weight=6)


# ---- layouts

_NUM = "num AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM memories)"


@register(f"""{_NUM}, dom AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT tags[1] AS d FROM memories))
SELECT id, round(10 * sin(acos(1 - 2 * (i + 0.5::DOUBLE) / n)) * cos(pi() * (1 + sqrt(5)) * (i + 0.5::DOUBLE)) + 3 * cos(2 * pi() * k / nd), 4) AS x,
round(10 * sin(acos(1 - 2 * (i + 0.5::DOUBLE) / n)) * sin(pi() * (1 + sqrt(5)) * (i + 0.5::DOUBLE)) + 3 * sin(2 * pi() * k / nd), 4) AS y,
round(10 * cos(acos(1 - 2 * (i + 0.5::DOUBLE) / n)) + (k - nd / 2) * 0.5::DOUBLE, 4) AS z FROM num JOIN dom ON d = tags[1]""")
def layout_sphere(m):
    return _rows(layout.sphere(m), x=4, y=4, z=4)


@register(f"""{_NUM}, t AS (SELECT *, i / (n - 1)::DOUBLE AS s, greatest(3, floor(sqrt(n) / 5)) AS turns, ({AS_OF} - ts) / 3600.0::DOUBLE AS age FROM num)
SELECT id, round((2 + 13 * s) * cos(s * turns * 2 * pi()), 4) AS x, round((2 + 13 * s) * sin(s * turns * 2 * pi()), 4) AS y, round(-8 + 16 * s + age / (SELECT max(age) FROM t) * 5, 4) AS z FROM t""")
def layout_spiral(m):
    return _rows(layout.spiral(m, AS_OF), x=4, y=4, z=4)


@register(f"""{_NUM}, g AS (SELECT *, ceil(round(power(n, 1.0::DOUBLE / 3), 9))::BIGINT AS g FROM num)
SELECT id, round((i // (g * g)) * 2.0::DOUBLE - g * 2.0::DOUBLE / 2, 4) AS x, round(((i // g) % g) * 2.0::DOUBLE - g * 2.0::DOUBLE / 2, 4) AS y, round((i % g) * 2.0::DOUBLE - g * 2.0::DOUBLE / 2, 4) AS z FROM g""")
def layout_grid(m):
    return _rows(layout.grid(m), x=4, y=4, z=4)


@register(f"""{_NUM}, l AS (SELECT *, least(4, floor(log2(n)) + 1) AS levels FROM num), v AS (SELECT *, least(floor(log2(i + 1)), levels - 1) AS level FROM l)
SELECT id, level::INTEGER AS level, CASE WHEN i > 0 THEN (i - 1) // 2 END AS parent,
round(CASE WHEN level = 0 THEN 0 ELSE level * 1.5::DOUBLE * cos((i - (power(2, level) - 1)) / power(2, level) * 2 * pi()) END, 4) AS x,
round(CASE WHEN level = 0 THEN 0 ELSE level * 1.5::DOUBLE * sin((i - (power(2, level) - 1)) / power(2, level) * 2 * pi()) END, 4) AS y, round(CASE WHEN level = 0 THEN 0 ELSE 2.0::DOUBLE * level / levels END, 4) AS z FROM v""")
def layout_tree(m):
    return _rows(layout.binary_tree(m), x=4, y=4, z=4)


@register("""SELECT id, domain, place::INTEGER AS place, least(4, place // 10)::BIGINT AS level FROM (SELECT id, tags[1] AS domain, row_number() OVER (PARTITION BY tags[1] ORDER BY activation DESC, id) - 1 AS place FROM memories) WHERE place < 50""")
def tree_levels(m):
    return layout.domain_levels(m).select("id", "domain", "place", F.col("level").cast("long").alias("level"))


@register(f"SELECT {_LEVEL} AS level, count(*) AS n, round(avg(activation), 6) AS mean_activation FROM memories GROUP BY 1")
def freshness_hierarchy(m):
    return _rows(layout.freshness_hierarchy(m), mean_activation=6)


@register(f"""l AS (SELECT *, {_LEVEL} AS level FROM memories), p AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY activation DESC, id) - 1 AS i FROM l)
SELECT id, level, round((sqrt(i) * 0.5::DOUBLE + activation * 0.3::DOUBLE) * cos(i * {layout.GOLDEN!r}::DOUBLE), 4) AS x, round((sqrt(i) * 0.5::DOUBLE + activation * 0.3::DOUBLE) * sin(i * {layout.GOLDEN!r}::DOUBLE), 4) AS y, round(level * 2.0::DOUBLE + activation * 0.5::DOUBLE, 4) AS z FROM p""")
def layout_golden(m):
    return _rows(layout.golden_levels(m), x=4, y=4, z=4)


@register("""root AS (SELECT id, tags FROM memories ORDER BY activation DESC, id LIMIT 1),
near AS (SELECT m.id, CAST(row_number() OVER (ORDER BY m.id) AS INTEGER) AS place FROM memories m, root r WHERE m.id <> r.id AND (m.tags[1] = r.tags[1] OR list_has_any(m.tags, r.tags)) ORDER BY m.id LIMIT 20)
SELECT id, 0 AS place FROM root UNION ALL SELECT id, place FROM near""")
def fractal_explorer(m):
    return layout.explorer(m)


@register("SELECT CASE WHEN n <= 50000 THEN 0 ELSE 4 END AS near_level, CASE WHEN n <= 50000 THEN 0 ELSE 4 END AS far_level, n FROM (SELECT count(*) AS n FROM memories)")
def detail_level(m):
    n = F.col("n")
    return m.agg(F.count("*").alias("n")).select(layout.detail_level(n, F.lit(0.0)).alias("near_level"), layout.detail_level(n, F.lit(60.0)).alias("far_level"), "n")


@register()
def layout_pca(m):
    return _rows(layout.principal(m, AS_OF), x=6, y=6, z=6)


@register()
def cluster_representatives(m):
    return _rows(layout.representatives(m, AS_OF, 20), activation=6, age_hours=6)


# ---- accesses by time, in one go and as streams

_DAY = "SELECT (ts_us // 86400000000) * 86400 AS start, count(*) AS n, round(sum(boost), 6) AS boost FROM accesses GROUP BY 1"


@register(_DAY, "a")
def access_tumbling(a):
    return _rows(streams.tumbling(a), boost=6)


@register("SELECT s AS start, count(*) AS n, round(sum(boost), 6) AS boost FROM (SELECT boost, unnest([(ts_us // 43200000000) * 43200, (ts_us // 43200000000) * 43200 - 43200]) AS s FROM accesses) GROUP BY 1", "a")
def access_sliding(a):
    return _rows(streams.sliding(a), boost=6)


_SESSIONS = """o AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM accesses WINDOW w AS (PARTITION BY id ORDER BY ts_us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts_us, event_id) AS k FROM o) SELECT id, min(ts_us) AS start_us, count(*) AS n FROM s GROUP BY id, k"""


@register(_SESSIONS, "a")
def access_sessions(a):
    return streams.sessions(a)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.sources.tables import BOOSTS

    boost = F.create_map(*[F.lit(x) for kv in BOOSTS.items() for x in kv])
    e = streams.stream(spark, sf_dir, "events").where(F.col("event_type").isin(*BOOSTS))
    return e.select(F.col("user_id").alias("id"), micros("ts").alias("ts_us"), boost[F.col("event_type")].alias("boost"), "event_id")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(streams.drained(streams.tumbling(_streamed(spark, sf_dir), late="2 days"), "tumbling", "update", ["start"]), boost=6)


def stream_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drained(streams.activations(_streamed(spark, sf_dir)), "activations", "update", ["id"])
    return _rows(out.select("id", "activation", "n"), activation=6)


QUERIES |= {"stream_tumbling": stream_tumbling, "stream_activations": stream_activations}
ORACLES["stream_tumbling"] = f"WITH {SQL_ACCESSES}\n{_DAY}"
ORACLES["stream_activations"] = f"""WITH {SQL_ACCESSES},
p AS (SELECT *, ln(1 - boost) - 1e-6 * (ts_us - coalesce(lag(ts_us) OVER (PARTITION BY id ORDER BY ts_us, event_id), ts_us)) / 1000000.0::DOUBLE AS log_p FROM accesses),
q AS (SELECT *, coalesce(sum(log_p) OVER (PARTITION BY id ORDER BY ts_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM p)
SELECT id, round(least(1.0::DOUBLE, 0.5::DOUBLE * exp(sum(log_p)) + sum(boost * exp(later))), 6) AS activation, count(*) AS n FROM q GROUP BY id"""


# ---- what a recall leaves behind, logs of searches and calls

_CTES, _, _FINALS = _recall("balanced").rpartition(" SELECT id, round(")


@register(f"""{_CTES}, r1 AS (SELECT id, round({_FINALS}),
r2 AS (SELECT id, round(10.0::DOUBLE * ((list_contains({_LOWTAGS}, 'en'))::INT + (list_contains({_LOWTAGS}, 'src3'))::INT) / 2 * (1 + activation), 6) AS score FROM memories WHERE list_has_any({_LOWTAGS}, ['en', 'src3']) ORDER BY score DESC, id LIMIT {LIMIT}),
r3 AS (SELECT id, activation FROM memories ORDER BY activation DESC, id LIMIT {LIMIT})
SELECT 'text' AS route, id, {AS_OF}000000 AS ts_us, 0.03::DOUBLE AS boost FROM r1 UNION ALL SELECT 'tags', id, {AS_OF}000000, 0.03 FROM r2 UNION ALL SELECT 'active', id, {AS_OF}000000, 0.03 FROM r3""")
def recall_router(m):
    """The three routes of recall, each with the accesses that it leaves behind."""
    routes = {"text": (TEXT, TAGS), "tags": (None, TAGS), "active": (None, None)}
    out = [recall.read_boosts(recall.recall(m, t, g, LIMIT, AS_OF), AS_OF).select(F.lit(k).alias("route"), "id", "ts_us", "boost") for k, (t, g) in routes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(f"""hit AS ({_HITS}), want AS (SELECT tags[1] AS query, id FROM memories),
n AS (SELECT w.query, (SELECT count(*) FROM hit h WHERE h.query = w.query) AS got, count(*) AS want, (SELECT count(*) FROM hit h JOIN want x ON h.query = x.query AND h.id = x.id WHERE h.query = w.query) AS hits FROM want w GROUP BY w.query),
q AS (SELECT hits / got AS p, hits / want AS r, 2.0::DOUBLE * hits / (got + want) AS f FROM n)
SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, round(stddev_samp(f), 6) AS f1_deviation, round(avg((f > 0.5)::INT), 6) AS pass_rate FROM q""")
def quality_summary(m):
    want = m.select(F.col("tags")[0].alias("query"), "id")
    pairs = F.array(*[F.when(T.has_word(F.lower("content"), w), F.lit(d)) for d, w in (("en", "the"), ("de", "der"), ("fr", "les"), ("es", "los"))])
    got = m.select(F.explode(F.array_compact(pairs)).alias("query"), "id")
    return _rows(recall.quality_summary(recall.quality(got, want)), precision=6, recall=6, f1=6, f1_deviation=6, pass_rate=6)


@register("""log AS (SELECT event_id % 4 + 1 AS tier, boost * 1000 AS ms FROM accesses)
SELECT tier, count(*) AS n, round(avg(ms), 6) AS mean, round(min(ms), 6) AS best, round(max(ms), 6) AS worst FROM log GROUP BY ROLLUP (tier)""", "a")
def search_stats(a):
    """Accesses stand for searches: their number chooses the tier, their boost is how long they took."""
    return _rows(stats.searches(a.select((F.col("event_id") % 4 + 1).alias("tier"), (F.col("boost") * 1000).alias("ms"))), mean=6, best=6, worst=6)


@register("""log AS (SELECT 'op' || (event_id % 3) AS operation, boost * (1 + event_id % 3) AS seconds FROM accesses),
g AS (SELECT operation, count(*) AS n, sum(seconds) AS seconds, count(*) / sum(seconds) AS rate FROM log GROUP BY operation)
SELECT operation, n, round(seconds, 6) AS seconds, round(rate, 6) AS rate, round(rate / (SELECT rate FROM g WHERE operation = 'op2'), 6) AS speedup FROM g""", "a")
def performance_stats(a):
    log = a.select(F.concat(F.lit("op"), (F.col("event_id") % 3).cast("string")).alias("operation"), (F.col("boost") * (1 + F.col("event_id") % 3)).alias("seconds"))
    return _rows(stats.performance(log, "op2"), seconds=6, rate=6, speedup=6)


# ---- links of new memories, records in files, rows of other tables


@register("""t AS (SELECT id, tags[1] AS domain, tags[1] || '_' || tags[2] AS topic FROM memories),
p AS (
  SELECT id, lag(id, k) OVER (PARTITION BY k, topic ORDER BY id) AS to_id, 'topic' AS kind, 0 AS rank, k FROM t, (SELECT unnest([1, 2, 3]) AS k)
  UNION ALL SELECT id, CASE WHEN lag(topic, k) OVER w <> topic THEN lag(id, k) OVER w END, 'domain', 1, k FROM t, (SELECT unnest([1, 2]) AS k) WINDOW w AS (PARTITION BY k, domain ORDER BY id)
  UNION ALL SELECT id, CASE WHEN id % 10 = 0 AND lag(domain, k) OVER w <> domain THEN lag(id, k) OVER w END, 'cross', 2, k FROM t, (SELECT unnest([1, 2]) AS k) WINDOW w AS (PARTITION BY k ORDER BY id))
SELECT id AS from_id, to_id, kind FROM p WHERE to_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, k) <= 5""")
def related_selection(m):
    return graph.chosen_related(m, F.col("tags")[0], F.concat_ws("_", F.col("tags")[0], F.col("tags")[1]))


_SIZES = "o AS (SELECT from_id, list(link_type) AS kinds FROM links GROUP BY from_id), z AS (SELECT id, ts, 67 + strlen(node_type) + strlen(content) + CASE WHEN version_of IS NULL THEN 0 ELSE 36 END + list_sum(list_transform(tags, lambda t: 1 + strlen(t))) + coalesce(list_sum(list_transform(kinds, lambda t: 41 + strlen(t))), 0) AS bytes FROM memories LEFT JOIN o ON id = from_id)"


def _sizes(m: DataFrame, l: DataFrame) -> DataFrame:
    kinds = l.groupBy(F.col("from_id").alias("id")).agg(F.collect_list("link_type").alias("kinds"))
    size = T.record_bytes(F.col("content"), F.col("node_type"), F.col("version_of"), F.col("tags"), F.col("kinds"))
    return m.join(kinds, "id", "left").select("id", "ts", size.cast("long").alias("bytes"))


@register(f"{_SIZES} SELECT id // 1000 AS file, id, coalesce(sum(bytes) OVER (PARTITION BY id // 1000 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, bytes::BIGINT AS bytes FROM z", "ml")
def record_index(m, l):
    return store.record_index(_sizes(m, l))


@register(f"{_SIZES} SELECT id, rpad(id || ':update:' || ts || ':' || bytes::BIGINT, 128, ' ') AS entry FROM z", "ml")
def journal_rows(m, l):
    return store.journal(_sizes(m, l))


@register("SELECT id, content FROM memories")
def compression_round_trip(m):
    return records.unpacked(records.packed(m, "id", "content")).select(F.col("key").alias("id"), "content")


@register("SELECT id, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, (ts + 0.5)::DOUBLE AS seconds FROM memories")
def time_conversions(m):
    at = T.from_seconds(F.col("ts") + 0.5)
    return m.select("id", F.date_format(F.to_utc_timestamp(T.from_seconds(F.col("ts")), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("at"), T.to_seconds(at).alias("seconds"))


@register("""top AS (SELECT id, tags[1] AS d, ts FROM memories ORDER BY activation DESC, id LIMIT 100)
SELECT a.id AS a, b.id AS b, CASE WHEN a.d = b.d THEN 'semantic' WHEN abs(a.ts - b.ts) < 86400 THEN 'temporal' ELSE 'associative' END AS link_type FROM top a JOIN top b ON a.id < b.id WHERE (a.id * 31 + b.id * 17) % 10 < 3""")
def sampled_links(m):
    return graph.sampled_links(m, F.col("tags")[0])


def generated_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.sources import generated

    return generated.tree(spark)


def synced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers taken in as memories."""
    made = store.synced(read(spark, sf_dir, "customer"), "c_custkey", F.concat_ws(" of segment ", "c_name", "c_mktsegment"), ["c_mktsegment", "c_nationkey"], "fact", AS_OF)
    return made.select("id", "content", "node_type", F.array_join("tags", ",").alias("tags"), "ts", "activation")


def fractal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(layout.fractal(spark, 5), x=4, y=4, z=4)


def fractal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fractal_edges(layout.fractal(spark, 5))


QUERIES |= {"generated_tree": generated_tree, "synced_rows": synced_rows, "fractal_points": fractal_points, "fractal_edges": fractal_edges}
ORACLES["generated_tree"] = """WITH n AS (SELECT unnest(range(100)) AS id), q AS (SELECT id, id % 20 AS p, id // 20 AS domain FROM n)
SELECT id, CASE WHEN p = 0 THEN NULL WHEN p < 4 THEN id - p WHEN p < 10 THEN id - p + 1 + (p - 4) % 3 ELSE id - p + 4 + (p - 10) % 6 END AS parent, domain,
CASE WHEN p = 0 THEN 'domain_root' WHEN p < 4 THEN 'topic' WHEN p < 10 THEN 'subtopic' ELSE 'concept' END AS node_type, CASE WHEN p = 0 THEN 1 WHEN p < 4 THEN 2 WHEN p < 10 THEN 3 ELSE 4 END AS level FROM q"""
ORACLES["synced_rows"] = f"SELECT c_custkey AS id, trim(c_name || ' of segment ' || c_mktsegment) AS content, 'fact' AS node_type, c_mktsegment || ',' || c_nationkey AS tags, {AS_OF}::BIGINT AS ts, 1.0::DOUBLE AS activation FROM customer"
_POINTS = "p AS (SELECT i + (4 ** level - 1) / 3 AS point, level, i / (4 ** level) * 2 * pi() AS t FROM (SELECT unnest(range(5)) AS level) l, LATERAL (SELECT unnest(range((4 ** level)::BIGINT)) AS i))"
ORACLES["fractal_points"] = f"""WITH {_POINTS}, q AS (SELECT *, 0.2::DOUBLE * sin(t * (level + 1)) * cos(t * (level + 2)) AS noise, 1 + level * 0.8::DOUBLE AS r FROM p)
SELECT point::BIGINT AS point, level::INTEGER AS level, round(r * cos(t) + noise, 4) AS x, round(r * sin(t) + noise, 4) AS y, round(level * 1.5::DOUBLE + 0.3::DOUBLE * sin(t * 3), 4) AS z FROM q"""
ORACLES["fractal_edges"] = f"WITH {_POINTS} SELECT point::BIGINT AS a, unnest(range(((4 ** (level + 1) - 1) / 3)::BIGINT, ((4 ** (level + 1) - 1) / 3)::BIGINT + 4)) AS b FROM p WHERE level < 4"


@register("""root AS (SELECT id, tags FROM memories ORDER BY activation DESC, id LIMIT 1),
near AS (SELECT m.id, row_number() OVER (ORDER BY m.id) AS place FROM memories m, root r WHERE m.id <> r.id AND (m.tags[1] = r.tags[1] OR list_has_any(m.tags, r.tags)) ORDER BY m.id LIMIT 20)
SELECT id, 0 AS level FROM root UNION ALL SELECT id, CASE WHEN place <= 3 THEN 1 WHEN place <= 15 THEN 2 ELSE 3 END FROM near""")
def fractal_tree(m):
    found = layout.explorer(m)
    return layout.branches(found.where("place = 0"), found.where("place > 0"))


# ---- conversations


def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, weight): every turn of a conversation to the one before it."""
    t = read(spark, sf_dir, "conversations").where("turn > 0")
    own = F.col("conv_id") * 1000 + F.col("turn")
    have = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("to_id"))
    return t.select(own.alias("from_id"), (own - 1).alias("to_id"), F.lit(0.7).alias("weight")).join(have, "to_id", "left_semi").select("from_id", "to_id", "weight")


QUERIES["conversation_links"] = conversation_links
ORACLES["conversation_links"] = "SELECT conv_id * 1000 + turn AS from_id, conv_id * 1000 + turn - 1 AS to_id, 0.7::DOUBLE AS weight FROM conversations c WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 1)"
