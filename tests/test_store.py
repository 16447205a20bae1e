"""The store's operators on small hand-made tables, with values worked out by hand or by plain Python."""

import json
import math
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from recollect.functions import decay, fuzzy
from recollect.functions import text as T
from recollect.operators import graph, layout, recall, sharding, stats, versions
from recollect.sources import mex, store
from recollect.streaming import accesses as streams

LINKS = "from_id long, to_id long, weight double, link_type string, pos int"
MEMORIES = "id long, content string, node_type string, version int, ts long, activation double, decay_rate double, version_of long, tags array<string>"


@pytest.fixture(scope="module")
def mini(spark):
    edges = [(1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.8), (3, 4, 0.4), (4, 5, 0.3), (5, 1, 0.6)]
    return spark.createDataFrame([(a, b, w, "related", k) for k, (a, b, w) in enumerate(edges)], LINKS)


def nodes(spark, rows):
    """rows: id -> (content, version, activation, version_of, tags)"""
    return spark.createDataFrame([(i, c, "fact", v, 0, a, 0.02, p, t) for i, (c, v, a, p, t) in rows.items()], MEMORIES)


def as_map(df, k="id", v="a"):
    return {r[k]: r[v] for r in df.collect()}


def test_spread_by_hand(spark, mini):
    at = spark.createDataFrame([(1, 1.0)], "id long, a double")
    got = as_map(graph.spread_sum(at, mini, 2), v="score")
    assert got == pytest.approx({2: 0.63, 3: 0.35, 4: 0.31556})
    m = nodes(spark, {i: ("x", 1, 0.5, None, []) for i in range(1, 6)})
    first = as_map(graph.spread_first(at, m, mini, hops=2))
    assert first == pytest.approx({1: 1.0, 2: 0.63, 3: 0.35, 4: 0.63 * 0.8 * 0.49})
    most = as_map(graph.spread_max(at, m, mini, hops=2))
    assert most == pytest.approx({1: 1.0, 2: 0.63, 3: 0.35, 4: 0.63 * 0.8 * 0.49})
    only = nodes(spark, {i: ("x", 1, 0.5, None, []) for i in (1, 3, 4)})
    assert set(as_map(graph.spread_max(at, only, mini, hops=2))) == {1, 3, 4}


def test_spread_matches_brute_force_on_random_graphs(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(30), rng.randrange(30)): rng.choice([0.3, 0.6, 0.9]) for _ in range(90)}
    links = spark.createDataFrame([(a, b, w, "related", k) for k, ((a, b), w) in enumerate(edges.items())], LINKS)
    want, level = {}, {0: 1.0, 5: 0.8}
    for hop in range(1, 4):
        new = {}
        for a, act in level.items():
            for (x, b), w in edges.items():
                if x == a:
                    v = act * w * 0.7**hop
                    want[b] = want.get(b, 0) + v
                    if v > 0.1:
                        new[b] = max(new.get(b, 0), v)
        level = new
    at = spark.createDataFrame([(0, 1.0), (5, 0.8)], "id long, a double")
    assert as_map(graph.spread_sum(at, links, 3), v="score") == pytest.approx(want)


def test_components_are_smallest_ancestors(spark, mini):
    assert as_map(graph.components(mini), v="component") == {1: 1, 2: 1, 3: 1, 4: 1}
    rng = random.Random(2)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    reach = {v: {v} for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[a] <= reach[b]:
                reach[b] |= reach[a]
                changed = True
    low = {v: min(s) for v, s in reach.items()}
    sizes = {c: list(low.values()).count(c) for c in low.values()}
    links = spark.createDataFrame([(a, b, 0.9, "related", 0) for a, b in edges], LINKS)
    assert as_map(graph.components(links), v="component") == {v: c for v, c in low.items() if sizes[c] > 1}


def test_paths(spark, mini):
    path = lambda a, b, **k: [r.path for r in graph.find_path(spark, mini, a, b, **k).collect()]
    assert path(1, 4) == [[1, 2, 4]] and path(1, 1) == [[1]] and path(1, 5) == [[1, 2, 4, 5]]
    assert path(1, 5, depth=2) == [] and path(1, 5, least=0.35) == []


def test_within_and_degrees(spark, mini):
    m = nodes(spark, {i: ("x", 1, 0.5, None, []) for i in (1, 2, 4)})
    assert as_map(graph.within(m.where("id = 1").select("id"), mini, m, 3), v="hops") == {2: 1, 4: 2}
    assert as_map(graph.degrees(mini), v="degree") == {1: 3, 2: 2, 3: 2, 4: 3, 5: 2}


def test_links_are_replaced_by_ends_and_type(spark, mini):
    m = nodes(spark, {i: ("x", 1, 0.5, None, []) for i in (1, 2, 3)})
    new = spark.createDataFrame([(1, 2, 7.0, "related"), (1, 3, 0.1, "other"), (1, 9, 0.5, "related")], "from_id long, to_id long, weight double, link_type string")
    got = {(r.from_id, r.to_id, r.link_type): r.weight for r in graph.upsert_links(mini, new, m).collect()}
    assert got[1, 2, "related"] == 1.0 and got[1, 3, "related"] == 0.5 and got[1, 3, "other"] == 0.1 and (1, 9, "related") not in got and len(got) == 7


def test_shared_tags_by_classes_and_by_pairs(spark):
    rng = random.Random(3)
    m = nodes(spark, {i: ("x", 1, 0.5, None, rng.sample("abcdef", rng.randint(0, 4))) for i in range(40)})
    n, w = {}, {}
    for r in graph.shared_tag_edges(m).collect():
        for x in (r.a, r.b):
            n[x], w[x] = n.get(x, 0) + 1, w.get(x, 0) + r.weight
    got = graph.shared_tags(m).collect()
    assert {r.id: r.n_edges for r in got} == n and {r.id: r.weight for r in got} == w


def test_registered_edges_are_the_pairs(spark, tmp_path):
    from recollect.plans import catalog

    rows = [(1, "x", "en", "src1"), (5, "x", "en", "src2"), (9, "x", "fr", "src1"), (6, "x", "en", "src1"), (3, "x", None, "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.weight for r in catalog.QUERIES["shared_tag_edges"](spark, str(tmp_path)).collect()}
    assert got == {(1, 5): 2, (1, 9): 2, (1, 6): 2}


def test_shared_tag_edges_take_less_than_half_a_byte_each(spark, tmp_path):
    m = spark.range(3000).select((F.col("id") * 7).alias("id"), F.array(F.lit("a"), F.lit("b"), (F.col("id") % 2).cast("string")).alias("tags"))
    graph.shared_tag_edges(m).write.parquet(f"{tmp_path}/edges")
    got = spark.read.parquet(f"{tmp_path}/edges").agg(F.count("*"), F.count_distinct("a", "b"), F.sum("weight"), F.bool_and(F.col("a") < F.col("b"))).first()
    same = 2 * (1500 * 1499 // 2)
    assert tuple(got) == (3000 * 2999 // 2, 3000 * 2999 // 2, 3 * same + 2 * 1500 * 1500, True)
    assert sum(f.stat().st_size for f in (tmp_path / "edges").glob("*.parquet")) < 3000 * 2999 // 4


def test_version_roots_with_loops_and_gaps(spark):
    parents = {1: None, **{i: i - 1 for i in range(2, 40)}, 50: 51, 51: 50, 60: 99, 61: 60, 70: 70, 80: 50}
    m = nodes(spark, {i: ("x", 1, 0.5, p, []) for i, p in parents.items()})
    want = {i: 1 for i in range(1, 40)} | {i: i for i in (50, 51, 60, 61, 70, 80)}
    assert as_map(versions.roots(m), v="root") == want


def test_consolidation(spark):
    m = nodes(spark, {1: ("old", 1, 0.9, None, ["a", "b"]), 2: ("new", 2, 0.2, 1, ["b", "c"]), 3: ("alone", 1, 0.1, None, [])})
    one = {r.root: r for r in versions.consolidate(m).collect()}
    assert (one[1].id, one[1].content, one[1].version, one[1].activation, one[1].tags, one[1].version_of) == (2, "new", 2, 0.9, ["a", "b", "c"], None)
    links = spark.createDataFrame([(1, 3, 0.5, "related", 0), (2, 3, 0.8, "other", 0), (2, 1, 0.9, "version", 1)], LINKS)
    assert {tuple(r) for r in versions.consolidate_links(m, links).collect()} == {(2, 3, 0.5, "related"), (2, 1, 0.9, "version")}
    row, own = versions.new_version(m, links, 2, 10, "newest", 5)
    assert tuple(row.select("id", "version", "version_of", "activation").first()) == (10, 3, 1, 1.0)
    assert {(r.from_id, r.to_id) for r in own.collect()} == {(10, 3), (10, 1)}


def test_queries_are_analysed():
    q = T.query("The  quick-brown Fox is in a Box")
    assert q.original == ("box", "fox", "quick-brown", "the") and q.processed == ("box", "brown", "fox", "quick")
    assert q.phrases[:3] == ("the quick-brown", "the quick-brown fox", "quick-brown fox") and "is in" not in q.phrases


def test_recall_tiers_and_threshold(spark):
    m = nodes(spark, {1: ("alpha beta gamma", 1, 0.9, None, ["t"]), 2: ("alpha", 1, 0.8, None, []), 3: ("delta", 1, 1.0, None, []), 4: ("beta gamma", 1, 0.01, None, [])})
    got = [r.id for r in recall.content_recall(m, "alpha beta", 5, 0, "balanced").collect()]
    assert got == [1, 2]  # 4 isn't active enough, 3 doesn't match
    assert recall.content_recall(m, "nothing here", 5, 0).count() == 0 and recall.content_recall(m, "alpha", 5, 0, "fuzzy").count() == 0
    assert [r.id for r in recall.content_recall(m, "alpha betta gamma", 1, 0, "fuzzy", fuzzy=True).collect()] == [1]
    t = lambda n, words, **k: spark.range(1).select(recall.adaptive_threshold(T.query(words), F.lit(n), **k)).first()[0]
    assert t(1, "a b") == pytest.approx(0.05) and t(40, "a") == pytest.approx(0.195) and t(20, "a b c d e f g") == pytest.approx(0.096)
    assert t(10, "a b", context="precise") == pytest.approx(0.14) and t(10, "a b", history=(0.5,) * 6) == pytest.approx(0.3)


def test_tag_recall(spark):
    m = nodes(spark, {1: ("x", 1, 0.9, None, ["A", "b"]), 2: ("x", 1, 0.8, None, [" a "]), 3: ("x", 1, 1.0, None, [])})
    assert [(r.id, r.score) for r in recall.tag_recall_any(m, ["a", "b"], 5).collect()] == [(1, 19.0), (2, 9.0)]
    assert [r.id for r in recall.tag_recall_all(m, ["a", "B", "unknown"], 5).collect()] == [1]
    assert recall.tag_recall_all(m, ["unknown"], 5).count() == 0


def test_long_texts_are_compared_by_stretches():
    import tracemalloc

    text = "ab cd " * 50_000 + "sich auf orantion"
    tracemalloc.start()
    try:
        assert fuzzy.partial("sich auf orantion", text) == 100
        assert tracemalloc.get_traced_memory()[1] < 10e6
    finally:
        tracemalloc.stop()


def test_batches_become_objects_piece_by_piece():
    import pyarrow as pa

    from recollect.functions import records

    rows = [(i, "x" * (3_000_000 if i == 7 else i * 20)) for i in range(1000)]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "text"])
    got = list(records._pieces(iter([b, b.slice(0, 0), b])))
    assert all(x.num_rows == 1 or x.nbytes <= records.PIECE for x in got)
    assert [tuple(r.values()) for x in got for r in x.to_pylist()] == rows + rows


def test_fuzzy_ratios():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = reduce(lambda r, j: [*r, row[j] + 1 if x == b[j] else max(r[-1], row[j + 1])], range(len(b)), [0])
        return row[-1]

    rng = random.Random(4)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
        s, t = sorted((a, b), key=len)
        if s:
            assert fuzzy.partial(a, b) == pytest.approx(max(100 * lcs(s, w) / len(s) for w in (t[i : i + len(s)] for i in range(len(t) - len(s) + 1))))
    assert fuzzy.ratio("", "") == 100 and fuzzy.token_set("b a", "a b c") == 100


def test_decay_models_by_hand(spark):
    a, r, s = F.lit(0.8), F.lit(0.0001), F.lit(3600)
    row = spark.range(1).select(
        decay.apply_decay(a, r, s).alias("e"), decay.apply_decay(a, r, s, "linear").alias("l"), decay.apply_decay(a, r, s, "power_law").alias("p"), decay.apply_decay(a, r, F.lit(-5)).alias("n"),
        decay.apply_decay(a, r, F.lit(10**7)).alias("f"), decay.boosted(a, 0.1, 3).alias("b"), decay.compounded(a, r, F.array(F.lit(100.0), F.lit(200.0))).alias("c"),
    ).first()
    assert (row.e, row.l, row.p) == pytest.approx((0.8 * math.exp(-0.36), 0.44, 0.8 * 2**-0.0001))
    assert row.n == 0.8 and row.f == 0.01 and row.b == pytest.approx(1 - 0.2 * 0.9**3) and row.c == pytest.approx(0.8 * math.exp(-0.03))


def test_fold_and_stream_agree_with_a_loop(spark, tmp_path):
    rng = random.Random(5)
    m = spark.createDataFrame([(i, 0.5, 1e-6, 0) for i in range(5)], "id long, activation double, decay_rate double, ts long")
    rows = [(rng.randrange(4), rng.randrange(10**12), k, rng.choice([0.02, 0.1])) for k in range(200)]
    acc = spark.createDataFrame(rows, "id long, ts_us long, event_id long, boost double")
    want = {}
    for i in range(5):
        act, last = 0.5, 0
        for _, t, _, b in sorted(x for x in rows if x[0] == i):
            act *= math.exp(-1e-6 * (t - last) / 1e6)
            act, last = act + (1 - act) * b, t
        want[i] = act * math.exp(-1e-6 * (10**6 - last / 1e6))
    assert as_map(stats.fold(m, acc, 10**6), v="activation") == pytest.approx(want)
    acc.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(acc.schema).parquet(str(tmp_path / "in"))
    got = {r.id: (r.activation, r.ts_us) for r in streams.drained(streams.activations(live), "act", "update", ["id"]).collect()}
    for i, (act, last) in got.items():  # the stream begins with the first access
        begin = min(t for j, t, *_ in rows if j == i)
        loop, at = 0.5, begin
        for _, t, _, b in sorted(x for x in rows if x[0] == i):
            loop *= math.exp(-1e-6 * (t - at) / 1e6)
            loop, at = loop + (1 - loop) * b, t
        assert act == pytest.approx(loop) and last == at


def test_ring_and_moves(spark):
    import hashlib

    shards = ["s1", "s2", "s3"]
    points = sharding.ring(shards)
    got = as_map(sharding.assign(spark.range(500), "id", shards), v="shard")
    for i, s in got.items():
        h = hashlib.md5(str(i).encode()).hexdigest()
        assert s == next((x for p, x in points if p >= h), points[0][1])
    moved = sharding.moves(spark.range(500), "id", shards, [*shards, "s4"]).collect()
    assert {r.new for r in moved} == {"s4"} and len(moved) < 250
    assert as_map(sharding.assign(spark.range(2), "id", []), v="shard") == {0: None, 1: None}


def test_eviction_cuts_ties_by_id(spark):
    m = spark.createDataFrame([(i, 0.001 if i % 2 else 0.5) for i in range(40)], "id long, activation double")
    assert {r.id for r in stats.evictable(m).collect()} == {1, 3, 5, 7}
    assert stats.evictable(m, 0.0001).count() == 0 and stats.evictable(m.where("1 = 0")).count() == 0


def test_numbering_and_layouts(spark):
    df = spark.range(100).select((F.col("id") * 7).alias("id")).repartition(5)
    assert [(r.id, r.i, r.n) for r in layout.numbered(df).orderBy("id").collect()] == [(k * 7, k, 100) for k in range(100)]
    p = layout.fractal(spark, 3)
    assert p.count() == 21 and layout.fractal_edges(p).count() == (1 + 4) * 4 and layout.cube_side(27) == 3 and layout.cube_side(28) == 4
    near = spark.range(1, 30).select("id", F.col("id").cast("int").alias("place"))
    tree = layout.branches(spark.createDataFrame([(0,)], "id long"), near, 2)
    assert as_map(tree.groupBy("level").count(), "level", "count") == {0: 1, 1: 3, 2: 12}


def test_text_functions(spark):
    texts = ["The big Cat saw the cat #One #Two_3", "", "a" * 150, ("word " * 30).strip(), 'a<b>:"c"/d  e__f']
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    c = F.col("t")
    r = d.select(T.simple_tags(c).alias("tags"), T.name_tags(c).alias("names"), T.summary(c).alias("s"), T.file_name(c).alias("f"), T.content_hash(c).alias("h")).collect()
    assert r[0].tags == ["big", "cat", "saw", "one"] and r[0].names == ["The", "Cat", "One", "Two_3"]
    assert r[1].s == "" and r[1].f == "unnamed" and r[2].s == "a" * 100 + "..." and r[3].s == ("word " * 20).strip() + "..."
    assert r[4].f == "a_b_c_d_e_f" and all(len(x.h) == 16 for x in r)
    k = [(x.chunk_no, x.chunk) for x in store.chunked(d.where("id = 2"), "id", "t", 60).collect()]
    assert k == [(0, "a" * 60), (1, "a" * 60), (2, "a" * 30)]
    assert store.chunk_links(store.chunked(d.where("id = 2"), "id", "t", 30), "id").count() == 1 + 2 + 3 + 3


U = "00000000-0000-0000-0000-0000000000"


def records():
    return [
        {"id": f"{U}01", "content": "naïve text", "node_type": "fact", "version": 3, "ts": 1.5, "activation": 0.5, "decay_rate": 0.25, "version_of": None, "links": [], "tags": ["a", "é"]},
        {"id": f"{U}02", "content": "", "node_type": "task", "version": 1, "ts": 2.0, "activation": 1.0, "decay_rate": 0.02, "version_of": f"{U}01", "links": [{"to_id": f"{U}01", "weight": 0.75, "link_type": "version"}], "tags": []},
    ]


def test_records_round_trip_and_size():
    raw = [mex.encode(r) for r in records()]
    assert [len(x) for x in raw] == [mex.size(r) for r in records()]
    back = [*mex.decode(b"".join(raw))]
    assert back[0][:5] == (f"{U}01", "naïve text", "fact", 3, 1.5) and back[0][9] == ["a", "é"] and back[0][7] is None
    assert back[1][7] == f"{U}01" and back[1][8] == [(f"{U}01", 0.75, "version")] and [*mex.decode(b"")] == []
    with pytest.raises(ValueError):
        [*mex.decode(raw[0][:-1])]
    with pytest.raises(ValueError):
        [*mex.decode(b"XXXX" + raw[0])]


def test_record_source(spark, tmp_path):
    spark.dataSource.register(mex.MexSource)
    df = spark.createDataFrame(records(), mex.SCHEMA)
    path = str(tmp_path / "mex")
    df.write.format("mex").mode("append").save(path)
    back = spark.read.format("mex").load(path)
    assert {r.id: (r.content, r.version, r.version_of, r.tags) for r in back.collect()} == {r["id"]: (r["content"], r["version"], r["version_of"], r["tags"]) for r in records()}
    df.limit(1).write.format("mex").mode("overwrite").save(path)
    assert spark.read.format("mex").load(path).count() == 1


def test_store(spark, tmp_path):
    from recollect.api import Store, quick_search

    s = Store(spark)
    a = s.insert("Alpha beta gamma", tags=["greek"], as_of=0)
    b = s.insert("beta delta", related=[a, "nobody"], as_of=0)
    with pytest.raises(ValueError):
        s.insert("  ")
    assert [r.id for r in s.search("alpha", as_of=0).collect()] == [a] and [r.id for r in s.search(tags=["GREEK"]).collect()] == [a]
    assert [r.id for r in s.related(b).collect()] == [a] and quick_search(s, "delta") == ["beta delta"]
    c = s.new_version(a, "Alpha again", as_of=10)
    assert [r.id for r in s.chain(c).collect()] == [a, c]
    s.link(a, b, 0.4)
    with pytest.raises(KeyError):
        s.link(a, "nobody")
    s.access([a, a], as_of=50)
    s.settle(as_of=100)
    want = decayed = math.exp(-0.02 * 50)
    for _ in range(2):
        decayed += (1 - decayed) * 0.1
    want = decayed * math.exp(-0.02 * 50)
    assert s.memories.where(F.col("id") == a).first().activation == pytest.approx(want)
    assert s.statistics()["total"] == 3 and s.statistics()["links"] == 3
    assert json.loads(s.export().where(F.col("id") == a).first().row)["content"] == "Alpha beta gamma"
    s.backup(str(tmp_path / "copy"))
    assert Store.restore(spark, str(tmp_path / "copy")).memories.count() == 3


def test_store_verbs_and_notes(spark):
    from recollect.api import Store

    s = Store(spark)
    one = s.insert("old and weak", as_of=0, decay_rate=1.0)
    s.put(spark.createDataFrame([("k1", "first text"), ("k2", "second text")], "id string, content string"), 5)
    s.put(spark.createDataFrame([("k2", "second text again"), ("k3", " ")], "id string, content string"), 6)
    assert s.statistics()["pending"] == 2 and s.flush() == 2 and s.flush() == 0
    assert {r.id: r.content for r in s.memories.collect()} == {one: "old and weak", "k1": "first text", "k2": "second text again"}
    held = s.by_type("fact")
    s.link("k1", "k2", 0.4)
    s.link("k1", "k2", 0.9, "cites")
    s.set_weight("k1", "k2", 0.2)
    assert sorted((r.link_type, r.weight) for r in s.links.collect()) == [("cites", 0.9), ("related", 0.2)]
    with pytest.raises(KeyError):
        s.set_weight("k2", "k1", 0.2)
    with pytest.raises(KeyError):
        s.update_activation("nobody")
    before = s.get("k1", as_of=5).first().activation
    assert s.update_activation("k1", as_of=100) < before <= 1
    assert s.cleanup(as_of=100) == 1 and s.memories.count() == 2 and held.count() == 3
    s.sync(spark.createDataFrame([(7, "Ann", "north")], "key int, name string, region string"), "key", F.col("name"), ["region"], as_of=100)
    assert s.by_tags(["NORTH"]).first().content == "Ann"
    note, page = s.add_note("Title", "a body", "ideas", ["x"]), s.add_book_note("The Book", "An Author", 3, "so it is")
    s.add_article("http://example.org", "Page", "says this")
    assert s.get(note).first().tags == ["ideas", "note", "x"] and [r.id for r in s.by_tags(["the_book"]).collect()] == [page]
    found = s.search("second text", as_of=600, note=True)
    assert s.accesses.count() == found.count() > 0
    index = s.record_index().collect()
    assert {r.id: r.bytes for r in index} == {r.id: r.bytes for r in s.record_sizes().collect()} and min(r.offset for r in index) == 0
    assert all(len(r.entry) == 128 and r.entry.startswith(r.id + ":update:") for r in s.journal().collect())
    n = s.memories.count()
    s.update_node(s.memories.where("id = 'k1'").withColumn("content", F.lit("changed")))
    s.append_node(spark.createDataFrame([("k9", "ninth")], "id string, content string"), as_of=100)
    s.optimize()
    assert s.apply_global_decay(as_of=100) == n + 1 == s.get_storage_stats()["total"] and s.get("k1").first().content == "changed"
    s.close()
    assert s.memories.count() == 0


def test_weights_quality_and_logs(spark):
    from recollect.functions.measure import Log

    q = spark.createDataFrame([("a", 1.0, 0.5, 0.6, True), ("b", 0.0, 0.5, 0.2, False)], "query string, precision double, recall double, f1 double, passed boolean")
    r = recall.quality_summary(q).first()
    assert (r.queries, r.precision, r.pass_rate) == (2, 0.5, 0.5) and r.f1_deviation == pytest.approx(0.2828427)
    log = Log()
    f = log.timed(lambda x: 1 / x)
    assert f(2) == 0.5
    with pytest.raises(ZeroDivisionError):
        f(0)
    g = {r.operation: r for r in stats.performance(log.table(spark), "<lambda>").collect()}
    assert g["<lambda>"].n == 2 and g["<lambda>"].speedup == 1
    s = {r.tier: r.n for r in stats.searches(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "tier int, ms double")).collect()}
    assert s == {1: 2, 2: 1, None: 3}


def test_words_and_tokens_are_found_without_taking_texts_apart(spark):
    from recollect.functions import text as T

    texts = ["The cat, sat", "cat's cat", "concat", "", "CAT_x cat", "a\tcat\u00a0b cat.", "\u00e9cat cat\u00e9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for w in ("cat", "cat,", "cat.", "cat's", "s", "\u00e9cat"):
        r = df.select(T.has_word(F.lower("t"), w).alias("a"), F.array_contains(T.words(F.col("t")), w).alias("b"), T.has_token(F.lower("t"), w).alias("c"), F.array_contains(T.tokens(F.col("t")), w).alias("d")).collect()
        assert all(x.a == x.b and x.c == x.d for x in r), (w, r)


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    from recollect.plans import shared

    right = shared.stage(spark.range(1000).withColumnRenamed("id", "k"), "right")
    left = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: shared.join_sized(left, right, "k", "inner", 8)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan()
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 7999)
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shared.unused("a", left.toDF("A"), right.toDF("_a")) == "__a"


def test_streams_that_forget_and_keep_thresholds(spark, tmp_path):
    from recollect.streaming import accesses as streams

    def drained(rows, schema, make, name):
        folder = tmp_path / name
        out = []
        for n, batch in enumerate(rows):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q = make(spark.readStream.schema(schema).parquet(str(folder))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True)
            q = q.foreachBatch(lambda b, _: out.extend(b.collect())).start()
            q.awaitTermination()
        return out

    day = 86_400_000_000
    rows = [[(1, 1000 * day, 1, 0.1), (2, 1000 * day, 2, 0.1)], [(2, 1010 * day, 3, 0.1)], [(2, 1011 * day, 4, 0.1)]]
    out = drained(rows, "id long, ts_us long, event_id long, boost double", lambda a: streams.activations(a, idle="1 day"), "idle")
    assert [r.n for r in out if r.id == 1] == [1, -1] and max(r.n for r in out if r.id == 2) >= 2
    ticks, kept = tmp_path / "ticks", []
    spark.sql("select timestamp_seconds(1000) as timestamp").coalesce(1).write.parquet(str(ticks))
    m = spark.createDataFrame([(1, 1.0)], "id long, activation double")
    streams.maintenance(spark.readStream.schema("timestamp timestamp").parquet(str(ticks)), lambda: m, lambda t, at: t.withColumn("at", F.lit(at)), lambda t, n: kept.extend(t.collect())).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.at) for r in kept] == [(1, 1000)]
    rows = [[("broad", i, 5, 2) for i in range(7)], [("broad", 9, 0, 1), ("precise", 9, 40, 8)]]
    out = drained(rows, "context string, at_us long, results long, words long", streams.thresholds, "thresholds")
    history = []
    for results, words in [(5, 2)] * 7 + [(0, 1)]:
        history.append(streams.threshold(0.1, results, words, "broad", history))
    last = {r.context: r for r in out}
    assert last["broad"].threshold == pytest.approx(history[-1]) and last["broad"].n == 8
    assert last["precise"].threshold == pytest.approx(0.1 * 1.5 * 0.8 * 1.4)


def test_commands(spark, tmp_path, capsys):
    from recollect.cli import main

    folder = str(tmp_path)
    assert main([folder, "insert", "remember the milk #shop"], spark) == 0
    ident = json.loads(capsys.readouterr().out)["id"]
    assert main([folder, "search", "milk"], spark) == 0 and json.loads(capsys.readouterr().out)["id"] == ident
    assert main([folder, "search-tags", "shop"], spark) == 0 and main([folder, "get", "none"], spark) == 1 and main([folder, "insert", " "], spark) == 2
    assert main([folder, "stats"], spark) == 0
    capsys.readouterr()
    assert main([folder, "health"], spark) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert main([folder, "shell"], spark, ["insert 'a second thing'", "", "search second", "nonsense", "exit", "stats"]) == 2
    assert json.loads(capsys.readouterr().out.splitlines()[1])["content"] == "a second thing"
    assert main([folder, "cleanup", "--least", "2"], spark) == 0 and json.loads(capsys.readouterr().out) == {"removed": 2}


def test_tables_that_are_empty(spark):
    m, l = spark.createDataFrame([], MEMORIES), spark.createDataFrame([], LINKS)
    assert stats.store(m, l).first().total == 0 and stats.links(m, l).first().density == 0 and versions.statistics(m).first().longest == 0
    assert recall.content_recall(m, "a word", 5, 0).count() == 0 and versions.roots(m).count() == 0 and graph.components(l).count() == 0
    assert recall.tag_recall_all(m, ["a"], 3).count() == 0 and layout.sphere(m).count() == 0


def test_generated_tables(spark):
    from recollect.sources import generated

    m, l = generated.memories(spark, 3000), generated.links(spark, 3000)
    rows = m.collect()
    assert rows == generated.memories(spark, 3000).collect() and len(rows) == 3000
    kinds = {k: sum(r.node_type == k for r in rows) / 30 for k, _ in generated.KINDS}
    assert all(abs(kinds[k] - w) < 3 for k, w in generated.KINDS)
    assert all(2 <= len(r.tags) <= 6 and 0.1 <= r.activation <= 1 for r in rows)
    pairs = [(r.from_id, r.to_id) for r in l.collect()]
    assert len(pairs) == len({*pairs}) and all(b < a for a, b in pairs) and max(pairs.count((a, b)) for a, b in pairs[:5]) == 1
