"""Each operator on small tables against a brute-force version, and on tables with every kind of odd row."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import language, language_model, line_dedup, mixing, near_dedup, neighbours, packing, phrases, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdfgklmnprst" for b in ("a", "e", "io", "u") for c in ("n", "rt", "", "sk", "lo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, text, share):
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < share else w for w in text.split(" "))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one doc_id with two texts, and extra columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [
        (1, prose(rng, 80), "en", "a", 1), (1, None, "en", "a", None), (None, prose(rng, 70), None, None, None), (None, None, None, None, None),
        (2, "", "en", "a", 0), (3, "  \n \n", "fr", "b", 4), (4, long, "en", "b", None), (5, long, None, "b", 9), (6, "ein\nzwei\nein", "de", "a", 12),
        (6, "ein\nzwei\nein", "de", "a", 12), (7, "x", "fr", None, 1), (7, "anderer text hier " + prose(rng, 60), "fr", None, 1), (8, "\U0001f600 é中", "fr", "c", 4), (9, "y" * 50_000, "de", "c", 50_000),
    ]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({x: F.lit("clash") for x in ("h", "g", "at", "x", "y", "sig", "n", "key", "rep", "run", "low", "first", "line", "odds", "rank", "count", "part", "value", "tag", "id")})


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None), (99, 1, 1), (1, 1, 0)], LABELS)


def empty(df):
    return df.where("1 = 0")


# ---- 1 mixing


def test_mixing_has_exact_sizes_and_follows_expected_copies(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 400), "en", "big" if i % 3 else f"small{i % 5}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"big": 1, **{f"small{k}": 1 for k in range(5)}}
    size = {r.source: r.n for r in mixing.sampled(docs, weights, 900).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert size == {s: 150 for s in weights}
    x = {i: len(bin(len(t))) - 2 for i, t, *_ in rows}
    total = Counter()
    for i, _, _, s, _ in rows:
        total[s] += x[i]
    seen = Counter()
    for seed in range(8):
        for r in mixing.sampled(docs, weights, 900, seed).select("doc_id", "copies").collect():
            e = 150 * x[r.doc_id] / total[rows[r.doc_id][3]]
            assert math.floor(e) <= r.copies <= math.floor(e) + 1
            seen[r.doc_id] += r.copies
    for s in weights:  # over several seeds, rows get what they should on average
        own = [(seen[i] / 8, 150 * x[i] / total[s]) for i, _, _, t, _ in rows if t == s]
        assert abs(np.mean([a for a, e in own if e < 0.9 or e > 1] or [0]) - np.mean([e for _, e in own if e < 0.9 or e > 1] or [0])) < 0.2


def test_mixing_matches_ranking_by_hand(spark):
    import hashlib

    docs = spark.createDataFrame([(i, "w" * (i * 7 % 50), "en", "s", 0) for i in range(100)], DOCS)
    got = {r.doc_id: r.copies for r in mixing.sampled(docs, {"s": 3}, 130).collect()}
    x = {i: len(bin(i * 7 % 50)) - 2 for i in range(100)}
    total = sum(x.values())
    certain, odds = {}, {}
    for i in x:
        certain[i], rest = divmod(130 * x[i], total)
        u = (int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if rest:
            odds[i] = u * (total - rest) / ((1 - u) * rest)
    drawn = set(sorted(odds, key=lambda i: (odds[i], i))[: 130 - sum(certain.values())])
    assert got == {i: n for i in x if (n := certain[i] + (i in drawn))}


def test_mixing_of_odd_rows(spark, odd):
    rows = mixing.sampled(odd).collect()
    assert sum(r.copies for r in rows) == odd.count()
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == odd.count()
    assert mixing.sampled(empty(odd)).count() == 0
    assert {r.source for r in mixing.sampled(odd, {None: 1}, 7).collect()} == {None}
    assert mixing.sampled(odd, {"nowhere": 1}).count() == 0


def test_mixing_with_clashing_columns_and_ties(spark):
    rows = [(1, "a b", "s", i % 2) for i in range(20)] + [(2, "c", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    for x in ("__u", "u", "row", "share", "total", "_copies", "at", "cut"):
        docs = docs.withColumn(x, F.lit("own"))
    drawn = mixing.sampled(docs, {"s": 1}, 5)
    assert drawn.columns == [*docs.columns, "__copies"]
    got = drawn.collect()
    assert sum(r["__copies"] for r in got) == 5 and {r["__u"] for r in got} == {"own"} and {*(r["copies"] for r in got)} <= {0, 1, 7}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.sampled(docs.repartition(3), {"s": 1}, 5).collect()))
    assert mixing.mixed(docs, {"s": 1}, 5).columns == docs.columns and mixing.mixed(docs, {"s": 1}, 5).count() == 5


# ---- 2 passages


def shared_positions(texts, length):
    where = {}
    for d, t in texts.items():
        w = t.split()
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add((d, i))
    return {p for places in where.values() if len({d for d, _ in places}) > 1 for p in places}


@pytest.mark.parametrize("bucket", [1 << 20, 40])
def test_passages_match_brute_force(spark, bucket):
    rng = random.Random(2)
    common = [prose(rng, n) for n in (49, 50, 51, 90)]
    texts = {i: " ".join([prose(rng, rng.randint(0, 60)), *rng.sample(common, rng.randint(0, 2)), prose(rng, rng.randint(0, 60))]) for i in range(60)}
    texts |= {100: common[3], 101: common[3], 102: prose(rng, 30), 103: texts[0], 104: (common[1] + " ") * 3}
    rows = substrings.repeated_passages(table(spark, list(texts.items())), bucket=bucket).collect()
    assert {(r.doc_id, i) for r in rows for i in range(r.start, r.stop - 49)} == shared_positions(texts, 50) | {(d, i) for d in (100, 101, 0, 103) for i in range(len(texts[d].split()) - 49)}
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    assert all(r.first_doc_id <= r.doc_id for r in rows)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 9, 5000), rng.integers(0, 50, 5000), rng.integers(0, 1000, 5000)]
    order = substrings.multikey_quicksort(cols)
    assert [tuple(c[i] for c in cols) for i in order] == sorted(zip(*cols))
    assert substrings.multikey_quicksort([np.zeros(0, np.int64)] * 3).tolist() == []
    assert substrings.multikey_quicksort([np.zeros(9, np.int64)] * 3).tolist() is not None


def test_passages_of_odd_rows(spark, odd):
    rows = {(r.doc_id, r.start, r.stop, r.first_doc_id) for r in substrings.repeated_passages(odd).collect()}
    assert rows == {(4, 0, 60_000, 4), (5, 0, 60_000, 4)}
    assert substrings.repeated_passages(empty(odd)).count() == 0


# ---- 3 lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines_to_remove(texts):
    places = [(line, (d, i)) for d, t in sorted(texts.items()) for i, line in enumerate(t.split("\n")) if line.strip(" \t\r\f\v")]
    first = {}
    for line, at in places:
        first.setdefault(line, at)
    out = set()
    for line, at in places:
        near = [p for other, p in first.items() if p < first[line] and abs(len(line) - len(other)) < 2 and edits(line, other) == 1]
        if near:
            out.add((*at, *min(near), 1))
        elif at != first[line]:
            out.add((*at, *first[line], 0))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 8)) for _ in range(40)] + ["a", "b", "ab", "aab", "aaab", "-", "\t"]

    def typo(s):
        i = rng.randrange(max(1, len(s)))
        return rng.choice([s[:i] + "é" + s[i:], s[:i] + s[i + 1 :], s[:i] + "q" + s[i + 1 :], s])

    texts = {d: "\n".join(typo(typo(rng.choice(base))) if rng.random() < 0.5 else rng.choice([*base, "", " "]) for _ in range(8)) for d in range(60)}
    rows = line_dedup.repeated_lines(table(spark, list(texts.items()))).collect()
    want = lines_to_remove(texts)
    assert sum(e for *_, e in want) > 30
    assert {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.edits) for r in rows} == want and len(rows) == len(want)
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(table(spark, list(texts.items()))).collect()}
    for d, t in texts.items():
        gone = {i for a, i, *_ in want if a == d}
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        assert left.get(d) == (kept if kept.strip() or not gone else None)


def test_lines_beyond_ascii_match_the_sql(spark, tmp_path):
    import duckdb

    from recollect.llm import queries

    lines = ["Are.", "Ére.", "Ère.", "Are.", "r\u00e9.", "re.", "\u4e2d\u6587", "\u4e2d\u6588", "\u4e2d", "\U0001f600!", "\U0001f601!", "\U0001f600", "ñ", "n", "ñu", "Ωa", "ωa", "éb", "eb", "eéb"]
    rng = random.Random(8)
    lines += ["".join(rng.choice("aéèñ\u4e2d") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    rng.shuffle(lines)
    table(spark, [(d, "\n".join(lines[d::20])) for d in range(20)]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["op3_line_dedup"](spark, str(tmp_path))
    want = con.sql(queries.ORACLES["op3_line_dedup"]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(e for *_, e in want) > 30


def test_lines_are_taken_out_once(spark):
    docs = table(spark, [(1, "a\nb"), (2, "a\nc"), (3, "a")])
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_variant_hashes_are_those_of_the_strings():
    whole = [line_dedup.variant_hashes(s)[-1] for s in ("bcd", "acd", "abd", "abc", "abcd")]
    assert line_dedup.variant_hashes("abcd").tolist() == [int(x) for x in whole]


def test_lines_of_odd_rows(spark, odd):
    rows = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no) for r in line_dedup.repeated_lines(odd).collect()}
    assert rows == {(6, 2, 6, 0), (5, 0, 4, 0)}
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == odd.count() - 1 and got.count((6, "ein\nzwei")) == 2 and (2, "") in got and (None, None) in got
    assert line_dedup.repeated_lines(empty(odd)).count() == 0 and line_dedup.drop_repeated_lines(empty(odd)).count() == 0


# ---- 4 language model


def reference_kneser_ney(texts, order):
    """Probabilities by dictionaries, from the definition."""
    start, stop = 0, 257
    top = Counter()
    for t in texts:
        s = [start] * (order - 1) + [b + 1 for b in t.encode()] + [stop]
        for i in range(len(s) - order + 1):
            top[tuple(s[i : i + order])] += 1
    levels = [top]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    info = []
    for c in levels:
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        d = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            own = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
            if all(0 < x < i for i, x in zip((1, 2, 3), own)):
                d = own
        total, weight = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            weight[g[:-1]] += d[min(v, 3) - 1]
        info.append((c, d, total, weight))

    def p(g):
        if not g:
            return 1 / 257
        c, d, total, weight = info[len(g) - 1]
        if g[:-1] not in total:
            return p(g[1:])
        v = c.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[g[:-1]] + weight[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


@pytest.mark.parametrize("bucket", [1 << 21, 97])
def test_language_model_matches_the_definition(spark, monkeypatch, bucket):
    monkeypatch.setattr(language_model, "BUCKET", bucket)
    monkeypatch.setattr(language_model, "FILES", 5)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(30)]
    model = language_model.fit(table(spark, list(enumerate(texts))), 4)
    p = reference_kneser_ney(texts, 4)
    unseen = [*texts[:5], "ézz qqq", "", prose(rng, 20)[::-1]]
    rows = {r.doc_id: r for r in language_model.scored(table(spark, list(enumerate(unseen))), model).collect()}
    for i, t in enumerate(unseen):
        s = [0] * 3 + [b + 1 for b in t.encode()] + [257]
        want = sum(math.log(p(tuple(s[k : k + 4]))) for k in range(len(s) - 3))
        assert rows[i].n_symbols == len(t.encode()) + 1
        assert rows[i].log_prob == pytest.approx(want, rel=1e-5)
        assert rows[i].perplexity == pytest.approx(math.exp(-want / rows[i].n_symbols), rel=1e-5)
    for context in ((0, 0, 0), tuple(b + 1 for b in texts[0].encode()[:3]), (1, 2, 3)):
        keys = np.array([(((context[0] << 9 | context[1]) << 9 | context[2]) << 9) | w for w in range(1, 258)])
        assert language_model.probabilities(keys, tuple(model)).sum() == pytest.approx(1, abs=1e-5)


def test_language_model_counts_words_and_knows_their_order(spark):
    import re

    rng = random.Random(8)
    sentences = [prose(rng, 7) for _ in range(60)]
    texts = [" ".join(rng.choice(sentences) for _ in range(6)) + f"\n{'once'[: i % 4]}{i}é." for i in range(80)]
    docs = table(spark, list(enumerate(texts)))
    seen = Counter(w for t in texts for w in re.findall(r" ?[a-z0-9é]+", t))
    for r in language_model.perplexities(docs).collect():
        found = re.findall(r" ?[a-z0-9é]+", texts[r.doc_id])
        spelled = len(texts[r.doc_id].encode()) - sum(len(w.encode()) - 1 for w in found if seen[w] > 1)
        assert r.n_symbols == spelled + 1
    model = language_model.fit(docs, language_model.ORDER, language_model.WORDS)
    prosaic = [" ".join(rng.choice(sentences) for _ in range(6)) for _ in range(10)]
    mixed = [" ".join(rng.sample(t.split(" "), len(t.split(" ")))) for t in prosaic]
    score = {r.doc_id: r.perplexity for r in language_model.scored(table(spark, list(enumerate(prosaic + mixed))), model).collect()}
    assert all(score[i + 10] > 5 * score[i] for i in range(10))
    s, at = language_model.symbols(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0].encode())]), model[0])
    every = np.arange(1, 258 + sum(c > 1 for c in seen.values()))
    for a, b in ((0, 0), (0, s[0]), (s[3], s[4]), (3, 2)):
        keys = (int(a) << 42) | (int(b) << 21) | every
        assert language_model.probabilities(keys, tuple(model)).sum() == pytest.approx(1, abs=1e-5)


def test_hash_arrays_in_several_parts(tmp_path):
    from recollect.llm import hash_arrays

    keys = np.arange(1000) * 7919 - 5000
    bucket, values = keys % 7, np.stack([np.arange(1000), np.arange(1000) % 3], 1)
    for p in range(3):  # two buckets each; the seventh isn't stored
        w = hash_arrays.Writer(f"{tmp_path}/t-{p}", 2)
        for b in (2 * p, 2 * p + 1):
            w.add(b, keys[bucket == b], values[bucket == b])
        w.close()
    got = hash_arrays.HashArrays(f"{tmp_path}/t", 2, [0, 1, 2], 2).get(bucket, keys)
    assert (got == np.where((bucket < 6)[:, None], values, 0)).all()
    assert (hash_arrays.HashArrays(f"{tmp_path}/t", 2, [0, 1, 2], 2).get(bucket, keys + 1) == 0).all()


def test_packed_keys_come_back():
    from recollect.llm import hash_arrays

    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 999))
    counts = np.arange(999) ** 3
    for i in (slice(0), slice(1), slice(None)):
        got = hash_arrays.unpack(hash_arrays.pack(keys[i], counts[i]))
        assert (got[0] == keys[i]).all() and (got[1] == counts[i]).all()


def test_language_model_of_odd_rows(spark, odd):
    rows = language_model.perplexities(odd).collect()
    assert len(rows) == odd.count() and sum(r.perplexity is None for r in rows) == 2
    assert all(r.perplexity >= 1 for r in rows if r.perplexity is not None)
    assert language_model.perplexities(empty(odd)).count() == 0


# ---- 5 packing


def test_sum_of_squares_matches_the_definition():
    rng = random.Random(6)
    for capacity in (1, 7, 40):
        sizes = [rng.randint(1, capacity) for _ in range(300)]
        bins, slots, n = packing.sum_of_squares(sizes, capacity)
        gaps = []
        for i, s in enumerate(sizes):
            count = Counter(g for g in gaps if 0 < g)

            def cost(old, new):
                c = count.copy()
                c[old] -= old in c
                c[new] += new > 0
                return sum(v * v for v in c.values() if v > 0)

            options = [(cost(g, g - s), g) for g in sorted({g for g in gaps if g >= s})] + [(cost(None, capacity - s), capacity + 1)]
            best = min(options)
            b = int(bins[i])
            if best[1] > capacity:
                assert b == len(gaps)
                gaps.append(capacity - s)
            else:
                assert gaps[b] == best[1]
                gaps[b] -= s
        assert n == len(gaps) and min(gaps) >= 0


def test_packing_holds_every_token_once(spark):
    rng = random.Random(7)
    texts = {i: prose(rng, rng.choice([0, 1, 5, 30, 63, 64, 200])) for i in range(300)}
    for shard in (1 << 26, 2000):
        rows = packing.packed(table(spark, list(texts.items())), 64, shard).collect()
        used, seen = Counter(), {}
        for r in rows:
            used[r.bin_id] += r.n_tokens
            seen.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        assert max(used.values()) <= 64 and len({(r.bin_id, r.slot) for r in rows}) == len(rows)
        for i, t in texts.items():
            at = 0
            for start, n in sorted(seen.get(i, [])):
                assert start == at
                at += n
            assert at == (len(t.split()) + 1 if t else 0)


def test_packing_of_odd_rows(spark, odd):
    rows = packing.packed(odd).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(r.text.split()) + 1 for r in odd.select("text").collect() if r.text and r.text.strip())
    assert {(r.doc_id, r.copy) for r in rows if r.doc_id == 6} == {(6, 0), (6, 1)} and any(r.doc_id is None for r in rows)
    assert packing.packed(empty(odd)).count() == 0


# ---- 6 phrases


def lz78(symbols):
    seen, word = set(), ()
    for c in symbols:
        word += (c,)
        if word not in seen:
            seen.add(word)
            word = ()
    return seen


def test_phrases_are_those_of_the_parse():
    rng = random.Random(8)
    ids = {w: rng.getrandbits(64) for w in WORDS[:12]}
    names = {}
    for n in (0, 1, 30, 400):
        text = [rng.choice(WORDS[:12]) for _ in range(n)]
        got, want = phrases.parse([ids[w] for w in text], [len(w) for w in text]), lz78(text)
        assert len({*got}) == len(got) == len(want)
        assert Counter(got.values()) == Counter(sum(map(len, p)) for p in want)
        for phrase in want:  # equal phrases have equal hashes wherever they stand
            h = 0
            for i, w in enumerate(phrase):
                h = (h * phrases._TIMES & phrases._ALL if i else 0) ^ ids[w]
            assert h in got and names.setdefault(phrase, h) == h
    assert len({*names.values()}) == len(names) > 100


def test_symbols_of_scripts_with_and_without_spaces():
    texts = ["ab  cd-e1", "", "é\u00e0 x", "中文abc字", "a\U0001f600b", "  ", "かな", "ю"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = phrases.symbols(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [["ab", "cd", "e1"], [], ["é\u00e0", "x"], ["中", "文", "abc", "字"], ["a", "\U0001f600", "b"], [], ["か", "な"], ["ю"]]


def classes_by_hand(rows, least):
    """{(doc_id, th): (class_id, links)} of (doc_id, th, sig) by comparing all."""
    docs = {(r.doc_id, r.th): None if r.sig is None else np.frombuffer(bytes(r.sig), np.uint32) for r in rows}
    keys, links, root = [*docs], Counter(), {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if docs[a] is not None and docs[b] is not None and (docs[a] == docs[b]).sum() >= least:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)), key=lambda d: (d[0], d[1]))
                root[high] = low
    return {d: (find(d)[0], links[d]) for d in docs}


@pytest.mark.parametrize("kind", ["phrases", "near"])
def test_signature_join_misses_no_link(spark, kind):
    rng = random.Random(9)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(25)]
    texts = {i: changed(rng, rng.choice(base), rng.choice([0, 0, 0.02, 0.1, 0.3])) for i in range(150)}
    docs = table(spark, list(texts.items()))
    if kind == "near":
        found, sigs, least = near_dedup.near_duplicates(docs), near_dedup.signatures(docs), near_dedup.LEAST
    else:
        found, sigs, least = phrases.similar_documents(docs), phrases.fingerprints(docs), phrases.LEAST
    want = classes_by_hand(sigs.collect(), least)
    got = {r.doc_id: (r.class_id, r.links) for r in found.collect()}
    assert got == {d: v for (d, _), v in want.items()} and sum(n for _, n in got.values()) > 100


def test_weighted_minimum_hashes_estimate_the_common_share_of_weight():
    rng = np.random.default_rng(5)
    h, length = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(1, 40, 300)
    a, b = np.arange(200), np.arange(100, 300)
    sig = phrases.weighted_minimum_hashes(np.concatenate([h[a], h[b]]), np.concatenate([length[a], length[b]]), np.array([0, 200, 400]), 4000)
    w = np.minimum(length, phrases.LONGEST) ** float(phrases.POWER)
    assert (sig[0] == sig[1]).mean() == pytest.approx(w[100:200].sum() / w.sum(), abs=0.04)


@pytest.mark.parametrize("short, block", [(3, 7), (40, 4096), (1000, 4096)])
def test_signature_join_with_a_value_that_all_share(spark, short, block):
    from recollect.llm.signatures import classes

    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 1 << 32, (6, 16), dtype=np.uint64).astype(np.uint32)[rng.integers(0, 6, 200)]
    sigs[rng.random(sigs.shape) < 0.25] = 7
    sigs[:, 5] = 1  # one posting list with every document
    rows = spark.createDataFrame([(i % 150, i, bytearray(s.tobytes()) if i % 40 else None) for i, s in enumerate(sigs)], "doc_id long, th long, sig binary")
    want = classes_by_hand(rows.collect(), 9)
    got = classes(rows, 16, 9, short, block).collect()
    assert {(r.doc_id, r.th): (r.first.doc_id, r.links) for r in got} == want and len(got) == 200
    assert len({v for v in want.values()}) > 10


def test_minimum_hashes_estimate_similarity(spark):
    rng = random.Random(10)
    texts = {0: prose(rng, 400)}
    texts |= {i: changed(rng, texts[0], i / 50) for i in range(1, 8)}
    sig = {r.doc_id: np.frombuffer(bytes(r.sig), np.uint32) for r in near_dedup.signatures(table(spark, list(texts.items())), 3, 256).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    for i in range(1, 8):
        a, b = grams(texts[0]), grams(texts[i])
        assert (sig[0] == sig[i]).mean() == pytest.approx(len(a & b) / len(a | b), abs=0.12)


def test_phrases_of_odd_rows(spark, odd):
    got = sorted((r.doc_id, r.class_id, r.links) for r in phrases.similar_documents(odd).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
    assert phrases.similar_documents(empty(odd)).count() == 0


# ---- 7 neighbours


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(8, 24))[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 24))
    docs = spark.createDataFrame([(i * 3, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in neighbours.nearest(docs).collect():
        got.setdefault(r.vec_id // 3, {})[r.rank] = (r.neighbour_id // 3, r.similarity)
    hits = 0
    for i in range(1500):
        assert sorted(got[i]) == list(range(1, 11))
        assert all(abs(s[i, j] - x) < 1e-4 for j, x in got[i].values())
        hits += len({j for j, _ in got[i].values()} & {*np.argsort(-s[i])[:10].tolist()})
    assert hits >= 0.9 * 15000


def test_the_beam_grows_until_recall_is_reached(spark):
    v = np.random.default_rng(12).normal(size=(3000, 32)).astype(np.float32)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    got = neighbours.nearest(docs, degree=6, beam=12).collect()
    assert len(got) == 30000
    assert sum(r.neighbour_id in want[r.vec_id] for r in got) >= 0.9 * 30000


def test_neighbours_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, other string, part string"
    x = ("c", "c", "c")
    rows = [(1, [1.0, 0.0], 1, *x), (1, [1.0, 0.0], 1, *x), (2, [0.0, 0.0], None, *x), (3, None, 1, *x), (None, [1.0, 1.0], 1, *x), (4, [1.0], 1, *x), (5, [1.0, None], 1, *x), (6, [1.0, 1.0], 1, *x), (7, [], 1, *x)]
    got = {(r.vec_id, r.neighbour_id): r.similarity for r in neighbours.nearest(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 2): 0, (2, 1): 0, (1, 6): 0.70711, (6, 1): 0.70711, (2, 6): 0, (6, 2): 0}
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    rows += [(8, [1.0, 1.0, 1.0, 1.0], 1, *x), (9, [float("inf"), 1.0], 1, *x), (10, [float("nan"), 1.0], 1, *x)]
    assert len(neighbours.nearest(spark.createDataFrame(rows, schema)).collect()) == 6
    assert {(r.vec_id, r.neighbour_id) for r in neighbours.nearest(spark.createDataFrame(rows, schema), every=6).collect()} == {(6, 1), (6, 2)}
    assert neighbours.nearest(spark.createDataFrame(rows, schema), dim=4).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert {(r.neighbour_id, r.rank) for r in neighbours.nearest(ties, every=300).collect()} == {(i, i) for i in range(1, 11)}
    assert neighbours.nearest(spark.createDataFrame(rows[:1], schema)).count() == 0


# ---- 8 toxicity


def test_toxicity_on_held_out_documents_and_misspellings(spark):
    rng = random.Random(12)
    bad = ["grobianisch", "schurkerei", "lumpenpack"]

    def text(toxic, words=bad):
        w = prose(rng, rng.randint(10, 300)).split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(words))
        return " ".join(w)

    data = [(text(i % 3 == 0), i % 3 == 0) for i in range(500)]
    model = toxicity.train([t for t, _ in data], np.array([y for _, y in data]))
    test = [(text(i % 2 == 0), i % 2 == 0) for i in range(200)]
    misspelt = [(text(True, ["grobianisk", "schurkereien", "lumpenpakc"]), True) for _ in range(50)]
    odds = [r.odds for r in toxicity.scored(table(spark, list(enumerate(t for t, _ in test + misspelt))), model).orderBy("doc_id").collect()]
    right = [(o >= 0) == y for o, (_, y) in zip(odds, test + misspelt)]
    assert np.mean(right[:200]) > 0.95 and np.mean(right[200:]) > 0.8


def test_toxicity_windows_and_score_match_brute_force():
    text = b" " + b" ".join(b"w%d" % (i * i) for i in range(29)) + b" "
    data = np.frombuffer(text, np.uint8)
    begin, end, off = toxicity.windows(data, np.array([0, len(data)]))
    words = text.split()
    got = [text[b:e].split() for b, e in zip(begin, end)]
    assert got == [words[i : i + 8] for i in range(0, 28, 4)] and off.tolist() == [0, 7]
    table_ = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    odds = toxicity.window_odds(data, begin, end, table_, 0.5)
    f, owner = toxicity._bags_of(data, begin, end)
    assert np.allclose(odds, np.bincount(owner, table_[f]) / np.bincount(owner) + 0.5, atol=1e-5)


def test_toxicity_of_odd_rows(spark, odd, labels):
    rows = toxicity.toxic_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.odds is None for r in rows if r.doc_id in (2, 3))
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(not r.toxic for r in rows)
    assert toxicity.toxic_documents(empty(odd), labels).count() == 0
    assert toxicity.toxic_documents(odd, empty(labels)).where("toxic = 1").count() == 0
    assert toxicity.drop_toxic(odd, empty(labels)).count() == odd.count()


# ---- 9 near duplicates


def test_near_duplicates_are_dropped_by_group(spark):
    rng = random.Random(13)
    base = [prose(rng, 150) for _ in range(6)]
    texts = {i: (changed(rng, base[i % 6], 0.03) if i < 30 else prose(rng, 150)) for i in range(50)}
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(table(spark, list(texts.items()))).collect()}
    assert kept == {*range(6), *range(30, 50)}


def test_components_of_a_chain(spark):
    from recollect.llm.signatures import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "doc_a long, doc_b long")
    assert {(r.doc_id, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted((r.doc_id, r.class_id, r.links) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0)]
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, None: 2, 2: 1, 3: 1, 4: 1, 6: 1, 7: 2, 8: 1, 9: 1})
    assert near_dedup.near_duplicates(empty(odd)).count() == 0 and near_dedup.drop_near_duplicates(empty(odd)).count() == 0


def test_no_row_is_lost_with_a_near_duplicate(spark):
    rng = random.Random(14)
    a, b = prose(rng, 90), prose(rng, 90)
    docs = table(spark, [(1, None), (1, None), (2, ""), (2, ""), (3, a), (4, a), (4, b), (4, b), (None, a), (None, a)])
    for x in ("doc", "TH", "_th"):
        docs = docs.withColumn(x, F.lit(1))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(1, None): 2, (2, ""): 2, (3, a): 1, (4, b): 1, (None, a): 2})


# ---- 10 languages


def test_code_points_and_ties(spark):
    from recollect.llm.arrays import code_points

    texts = ["aé中\U0001f600b", "", "ß", "x"]
    raw = [t.encode() for t in texts]
    got, at = code_points(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[ord(c) for c in t] for t in texts]
    docs = spark.createDataFrame([(1, "same", "q", "s", 0), (2, "same", "p", "s", 0)], DOCS)
    assert {r.language for r in language.languages(docs).collect()} == {"p"}


def test_language_on_held_out_documents(spark):
    rng = random.Random(14)
    kinds = {"aa": ["bako", "tilo", "zun"], "bb": ["schr", "kopf", "ung"], "cc": ["éau", "que", "ois"]}

    def text(lang):
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))

    rows = [(i, text(x := rng.choice([*kinds])), x, "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(language.sample(docs.where("doc_id < 200"), 40))
    got = {r.doc_id: r.language for r in language.identified(docs.where("doc_id >= 200"), model).collect()}
    assert sum(got[i] == x for i, _, x, _, _ in rows[200:]) >= 198


def test_language_scores_match_the_definition(spark):
    docs = spark.createDataFrame([(1, "abab", "p", "s", 0), (2, "bcbcc", "q", "s", 0), (3, "abc", None, "s", 0)], DOCS)
    langs, matrix = language.train(language.sample(docs))
    grams = {lang: Counter(t[i : i + n] for n in language.ORDERS for i in range(len(t) - n + 1)) for lang, t in (("p", " abab "), ("q", " bcbcc "))}

    def score(lang, t):
        total = sum(grams[lang].values()) + (1 << language.BITS)
        return sum(math.log((grams[lang][t[i : i + n]] + 1) / total) for n in language.ORDERS for i in range(len(t) - n + 1))

    p, q = score("p", " abc "), score("q", " abc ")
    row = language.identified(docs, (langs, matrix)).where("doc_id = 3").first()
    assert row.language == ("p" if p >= q else "q") and row.margin == pytest.approx(abs(p - q) / 9, rel=1e-4)


def test_language_of_odd_rows(spark, odd):
    rows = language.languages(odd).collect()
    assert len(rows) == odd.count() and all(r.language is None for r in rows if r.doc_id in (2, 3))
    assert language.languages(empty(odd)).count() == 0
    assert language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).where("language is not null").count() == 0


# ---- what is registered, as it is registered

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")


@pytest.fixture(scope="module")
def tables(spark):
    return {x: spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels", "embeddings")}


@needs_tables
@pytest.mark.parametrize("name", ["op1_source_mixing", "op3_line_dedup"])
def test_registered_queries_match_their_sql(spark, name):
    import duckdb

    from recollect.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert {*rel.columns} == {*df.columns}
    want = rel.select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want)) and want


@needs_tables
def test_registered_searches_and_scores_cover_their_tables(spark, tables):
    from recollect.llm import queries

    docs = [r for r in tables["documents"].collect() if r.text]
    ids = Counter(r.doc_id for r in tables["documents"].collect())
    assert Counter(r.doc_id for r in queries.op4_lm_scoring(spark, SF).collect()) == ids
    assert Counter(r.doc_id for r in queries.op10_language_id(spark, SF).collect()) == ids
    packed = Counter()
    for r in queries.op5_sequence_packing(spark, SF).collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == Counter({r.doc_id: len(r.text.split()) + 1 for r in docs if r.text.split()})
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, SF).collect()}
    assert toxic <= {*ids}
    v = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in tables["embeddings"].collect()}
    got = queries.op7_nearest_neighbours(spark, SF).collect()
    for q in {i for i in v if i % 100 == 0}:
        want = sorted((i for i in v if i != q), key=lambda i: -float(v[q] @ v[i]))[:10]
        assert len({r.neighbour_id for r in got if r.vec_id == q} & {*want}) >= 9


@needs_tables
def test_registered_duplicate_searches_match_brute_force(spark, tables):
    from recollect.llm import queries

    for found, sigs, least in (
        (queries.op6_phrase_fingerprints(spark, SF), phrases.fingerprints(tables["documents"]), phrases.LEAST),
        (queries.op9_near_dedup(spark, SF), near_dedup.signatures(tables["documents"]), near_dedup.LEAST),
    ):
        want = classes_by_hand(sigs.collect(), least)
        assert Counter((r.doc_id, r.class_id, r.links) for r in found.collect()) == Counter((d, c, n) for (d, _), (c, n) in want.items())
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    rows = queries.op2_substring_dedup(spark, SF).collect()
    whole = {t for t, n in Counter(texts.values()).items() if n > 1}
    copies = {(d, i) for d, t in texts.items() if t in whole for i in range(len(t.split()) - 49)}
    assert {(r.doc_id, i) for r in rows for i in range(r.start, r.stop - 49)} == shared_positions(texts, 50) | copies


@needs_tables
def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline

    docs = tables["documents"]
    columns = docs.columns
    odds = {r.doc_id for r in toxicity.toxic_documents(docs, tables["labels"]).where("toxic = 1").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - odds
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = {}
    for d, i, *_ in lines_to_remove(texts):
        gone.setdefault(d, set()).add(i)
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    cut = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}
    assert left == {d: t for d, t in cut.items() if t.strip() or d not in gone}
    want = classes_by_hand(near_dedup.signatures(docs).collect(), near_dedup.LEAST)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {c for c, _ in want.values()}
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() == docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "source mixing", "packing"]
    used = Counter()
    for r in out.collect():
        used[r.bin_id] += r.n_tokens
    assert used and max(used.values()) <= packing.CAPACITY
