import math
import random
import re
from collections import Counter

import pytest

from postsignal.functions import ids as I
from postsignal.operators import fingerprints as FP
from postsignal.operators import novelty as N
from postsignal.operators import similarity as S
from pyspark.sql import functions as F


def tfidf(docs, query, k):
    def terms(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    tfs = [terms(d) for d in docs]
    df = Counter(t for c in tfs for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    q, vs = unit(terms(query)), [unit(c) for c in tfs]
    sims = [sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vs]
    return sorted(enumerate(sims), key=lambda p: (-round(p[1], 9), p[0]))[:k]


def test_search_equals_full_ranking(spark):
    rnd = random.Random(3)
    vocab = ["gol", "maç", "derbi", "a", "hakem", "the", "penaltı", "x1"]
    docs = [" ".join(rnd.choices(vocab, k=rnd.randrange(0, 9))) for _ in range(40)] + ["gol maç", "gol maç"]
    queries = ["gol maç derbi", "unseen words", "", "hakem", "the the penaltı"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    got = {}
    for r in S.search(S.build_index(d), q, top_k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["similarity"])
    for i, query in enumerate(queries):
        want = tfidf(docs, query, 5)
        assert [got[i][j + 1][0] for j in range(5)] == [w[0] for w in want]
        assert [got[i][j + 1][1] for j in range(5)] == [pytest.approx(w[1], abs=1e-8) for w in want]


def test_an_index_for_queries_holds_their_terms_alone(spark):
    rnd = random.Random(8)
    docs = [" ".join(f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(rnd.randrange(0, 40))) for _ in range(150)] + ["", "w1 w2", "w1 w2"]
    queries = ["w1 w2 w3", "w5 w9 nowhere", "", docs[7]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    index = S.build_index(d, queries=q)
    asked = {t for x in queries for t in (x.split() + [f"{a} {b}" for a, b in zip(x.split(), x.split()[1:])])}
    assert {r.term for r in index.impacts.postings.select("term").distinct().collect()} == asked & {t for x in docs for t in (x.split() + [f"{a} {b}" for a, b in zip(x.split(), x.split()[1:])])}
    got = {}
    for r in S.search(index, q, top_k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["similarity"])
    for i, query in enumerate(queries):
        want = tfidf(docs, query, 5)
        assert [got[i][j + 1][0] for j in range(5)] == [w[0] for w in want]
        assert [got[i][j + 1][1] for j in range(5)] == [pytest.approx(w[1], abs=1e-8) for w in want]


def test_texts_are_searched_for_words_once_and_documents_counted_once(spark):
    rows = [(1, "gol maç gol maç"), (1, "maç hakem"), (2, "gol"), (3, None), (4, ""), (5, "a gol")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    dealt = S._dealt(docs, "doc_id", "text", 2)
    held, counts = S._part_terms(dealt), S._part_counts(dealt)
    assert plan(held).count("regexp_extract_all") == plan(counts).count("regexp_extract_all") == 1
    got = Counter()
    for r in held.collect():
        got[r["term"]] += r["n"]
    # pairs do not reach from one row of a document into the next
    assert got == {"gol": 3, "maç": 1, "hakem": 1, "gol maç": 1, "maç gol": 1, "maç hakem": 1}
    want = {(1, "gol"): 2, (1, "maç"): 3, (1, "hakem"): 1, (1, "gol maç"): 2, (1, "maç gol"): 1, (1, "maç hakem"): 1, (2, "gol"): 1, (5, "gol"): 1}
    assert {(r["doc"], r["term"]): r["tf"] for r in counts.collect()} == want


def test_style_examples_come_back_whole(spark):
    ex = spark.createDataFrame([(1, "gol maç", "t1"), (2, "hava", "t2")], "example_id int, text string, tone_tags string")
    q = spark.createDataFrame([(9, "gol")], "query_id int, text string")
    got = S.retrieve_examples(ex, q, top_k=1).collect()
    assert [(r["example_id"], r["tone_tags"]) for r in got] == [(1, "t1")]


def clusters(values, t):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if values[i][0] == values[j][0] and bin((values[i][1] ^ values[j][1]) & (2**64 - 1)).count("1") <= t:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def sample_values(seed, n=120):
    rnd = random.Random(seed)
    values = []
    while len(values) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 6)):
            for bit in rnd.sample(range(64), rnd.randrange(0, 8)):
                base ^= 1 << bit
            values.append((rnd.choice("pq") if rnd.random() < 0.2 else "p", base - (1 << 64) if base >> 63 else base))
    return values[:n]


@pytest.mark.parametrize("seed, blocks, hot", [(1, None, 20_000), (2, 9, 3), (3, 10, 20_000), (4, 12, 5)])
def test_pairs_and_clusters_equal_comparing_all(spark, seed, blocks, hot):
    values = sample_values(seed)
    df = spark.createDataFrame([(i, a, v) for i, (a, v) in enumerate(values)], "item int, algorithm string, bits long")
    distinct = sorted(set(values))
    want = {
        (a, x, y)
        for i, (a, x) in enumerate(distinct)
        for b, y in distinct[i + 1 :]
        if a == b and bin((x ^ y) & (2**64 - 1)).count("1") <= 8
    }
    rows = FP.near_pairs(df, 8, blocks, hot).collect()
    assert len(rows) == len(want)
    assert {(r["algorithm"], r["bits_a"], r["bits_b"]) for r in rows} == want
    got = {r["item"]: r["cluster_id"] for r in FP.cluster(df, threshold=8, blocks=blocks).collect()}
    assert [got[i] for i in range(len(values))] == clusters(values, 8)


def test_keys_and_values_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate of exploded keys is that of the values: it would collect all of them in the driver."""
    plan, plans, keep = lambda df: df._jdf.queryExecution().executedPlan().toString(), {}, FP.written

    def seen(df, name):
        plans[name] = plan(df)
        return keep(df, name)

    monkeypatch.setattr(FP, "written", seen)
    values = sample_values(4)
    items = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "item long, algorithm string, bits long")
    found = FP.cluster(items, threshold=8)
    assert "SortMergeJoin" in plans["key-entries"] and "Broadcast" not in plans["key-entries"]
    # the result joins the items with the label of their value
    assert "BroadcastHashJoin [algorithm" not in plan(found)
    got = {r["item"]: r["cluster_id"] for r in found.collect()}
    assert [got[i] for i in range(len(values))] == clusters(values, 8)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a int, b int")
    got = {r["node"]: r["root"] for r in FP.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert FP.components(edges.limit(0)).count() == 0


def test_hash_texts(spark):
    df = spark.createDataFrame([("dhash64-v1:ffffffffffffffff", "dhash64-v1:0"), ("0f", "0e"), ("a:1", "b:1"), ("a:", "a:1")], "a string, b string")
    got = df.select(I.hash_distance(F.col("a"), F.col("b")).alias("d"), I.near_duplicate(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r["d"], r["n"]) for r in got] == [(64, False), (1, True), (None, False), (1, True)]


def test_fatigue_equals_comparing_recent_texts(spark):
    rnd = random.Random(5)
    base = ["Low water at the pier tonight", "low water at the pier", "fog", "", None, "Ferry, ferry, ferry on time again and again"]
    rows = [(i, "hot" if rnd.random() < 0.7 else "b", i * 10, rnd.choice(base), rnd.choice(["", ".", " now", "!!!"])) for i in range(80)]
    rows = [(i, a, t, None if x is None else x + y) for i, a, t, x, y in rows]
    df = spark.createDataFrame(rows, "post_id int, author_handle string, ordinal int, text string").repartition(4)
    got = {r["post_id"]: (r["fatigue_score"], r["issue"]) for r in N.fatigue(df, window=45).collect()}

    def pairs(text):
        words = re.findall(r"\w+", (text or "").lower())
        return set(zip(words, words[1:])) if len(words) > 1 else set(words)

    for i, author, at, text in rows:
        a, s = pairs(text), 0.0
        for _, other, before, old in rows:
            if other == author and at - 45 <= before < at and a and pairs(old):
                s = max(s, 2 * len(a & pairs(old)) / (len(a) + len(pairs(old))))
        want = (80.0, "near_duplicate_text") if s >= 0.85 else (max(0.0, (s - 0.5) * 100), "")
        assert got[i] == (pytest.approx(want[0]), want[1])


def test_a_hot_phrase_makes_no_square(spark, monkeypatch):
    """All posts of an author hold one phrase, a fifth of each, and one text comes a thousand times: few pairs meet."""
    rnd = random.Random(8)
    texts = [" ".join([*(f"w{rnd.randrange(5000)}" for _ in range(12)), "win a prize now"]) for _ in range(600)]
    rows = [(i, "hot", i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot", 300, "the same old text") for i in range(500)] + [(1600 + i, "hot", 301 + i, "the same old text") for i in range(500)]
    rows += [(5000, "hot", 599, texts[400].replace("prize", "price"))]
    kept, written = {}, N.written
    monkeypatch.setattr(N, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    got = {r["post_id"]: r["fatigue_score"] for r in N.fatigue(spark.createDataFrame(rows, "post_id int, author_handle string, ordinal int, text string").repartition(5), window=700).collect()}
    assert kept["met"].count() < 20 * 600
    assert all(got[1600 + i] == 80.0 for i in range(500)) and all(got[1000 + i] == 0.0 for i in range(500))
    assert got[5000] > 0 and sum(got[i] > 0 for i in range(600)) < 30


def test_few_texts_of_an_author_need_no_row_for_a_shingle(spark, monkeypatch):
    """Stretches of few, of many and of either number of texts give the same scores; few are met without an index."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows, last = [], words[:12]
    for i in range(300):
        last = [rnd.choice(words) if rnd.random() < 0.15 else w for w in last] + ([] if rnd.random() < 0.9 else ["more"])
        rows.append((i, f"a{i % 3}", i, " ".join(last)))
    df = spark.createDataFrame(rows, "post_id int, author_handle string, ordinal int, text string").repartition(5)
    found, kept, written = {}, {}, N.written
    for few in (0, 12, 64):
        kept[few] = []
        monkeypatch.setattr(N, "FEW_SETS", few)
        monkeypatch.setattr(N, "written", lambda df, name: kept[few].append(name) or written(df, name))
        found[few] = {r["post_id"]: r["fatigue_score"] for r in N.fatigue(df, window=50).collect()}
    sets = [(a, at, set(zip(t.split(), t.split()[1:]))) for _, a, at, t in rows]
    for i, a, at, _ in rows:
        s = max([0.0, *(2 * len(x & sets[i][2]) / (len(x) + len(sets[i][2])) for other, before, x in sets if other == a and at - 50 <= before < at)])
        assert found[64][i] == pytest.approx(80.0 if s >= 0.85 else max(0.0, (s - 0.5) * 100))
    assert found[0] == found[12] == found[64] and sum(x > 0 for x in found[64].values()) > 30
    assert "shingles" in kept[0] and "shingles" in kept[12] and not {"shingles", "prefixes", "met"} & {*kept[64]}
