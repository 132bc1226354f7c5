"""Bursts, repeats, drift, samples and graph features against plain Python, with hot keys."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsignal.operators import drift as D
from postsignal.operators import graph_features as G
from postsignal.operators import rolling as R
from postsignal.operators import samples as S


def test_bursts_of_a_hot_series(spark):
    """One series holds most rows; its blocks are windows of their own, and halos give the same sums."""
    rnd = random.Random(1)
    rows = [("hot", rnd.randrange(400 * 10)) for _ in range(4000)] + [("hot", 2005)] * 60 + [("cold", 7), ("cold", 39), (None, 5), ("cold", None)]
    got = R.bursts(spark.createDataFrame(rows, "key string, at long"), ["key"], F.col("at"), step=10, width=5)
    counts = Counter((k, at // 10) for k, at in rows if at is not None)
    found = {(r.key, r.step): r for r in got.collect()}
    assert set(found) == set(counts)
    for (key, step), n in counts.items():
        past = [counts.get((key, step - i), 0) for i in range(1, 6)]
        mean, std = sum(past) / 5, statistics.pstdev(past)
        r = found[key, step]
        assert (r.n, r.mean) == (n, pytest.approx(mean)) and r.std == pytest.approx(std, abs=1e-9)
        assert r.z == pytest.approx((n - mean) / max(std, 1.0)) and r.burst == (r.z >= 3 and n >= 3)
    assert found["hot", 200].burst


def test_blocks_are_bounded(spark):
    cells = spark.range(5000).select(F.lit("hot").alias("key"), F.col("id").alias("at"), F.lit(1).alias("n"))
    summed = R.rolling_sums(cells, ["key"], "at", 10, {"s": F.col("n")})
    assert {r.at: r.s for r in summed.collect()} == {i: (min(i, 10) or None) for i in range(5000)}


def test_repeats(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(300)])) for i in range(800)]
    got = R.recent_repeats(spark.createDataFrame(rows, "item long, key string, at long"), "item", ["key"], F.col("at"), width=20, first_free=1, step=10.0)
    assert got.count() == 800
    for r in got.collect():
        _, key, at = rows[r.item]
        want = 0 if key is None or at is None else sum(k == key and t is not None and at - 20 <= t < at for _, k, t in rows)
        assert (r.repeats, r.fatigue) == (want, min(100.0, max(0.0, (want - 1) * 10.0)))


def test_buckets_keep_the_order(spark):
    values = [float("-inf"), -5e8, -1.0, -0.999, -1e-12, 0.0, 1e-10, 1e-6, 0.5, 0.51, 1.0, 7e7, float("inf"), None, float("nan")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", D.bucket(F.col("v")).alias("b")).orderBy("i").collect()
    found = [r.b for r in rows]
    assert found[-2:] == [None, None] and found[4] == found[5] == found[6] == 0
    assert found[:13] == sorted(found[:13]) and len(set(found[:13])) >= 9


def test_numeric_drift(spark):
    rnd = random.Random(3)
    rows = [("hot", 0, rnd.gauss(10, 2)) for _ in range(3000)] + [("hot", 1, rnd.gauss(10, 2)) for _ in range(3000)] + [("hot", 2, rnd.gauss(14, 2)) for _ in range(2000)]
    rows += [("hot", 2, None)] * 100 + [("rare", 1, 1.0), ("rare", 0, 1.0), ("new", 1, 2.0)]
    table = spark.createDataFrame(rows, "key string, period int, v double").repartition(5)
    got = {(r.key, r.period): r for r in D.numeric_drift(table, ["key"], "period", F.col("period") == 0, {"v": F.col("v")}).collect()}
    assert set(got) == {("hot", 1), ("hot", 2), ("rare", 1), ("new", 1)}
    same, moved = got["hot", 1], got["hot", 2]
    assert same.verdict == "stable" and moved.verdict == "major" and moved.current_n == 2100 and moved.reference_n == 3000
    bucket = lambda v: math.ceil(math.log(abs(v) / D.TINY) / math.log(D.RATIO)) * (1 if v > 0 else -1)
    base = sorted(bucket(v) for k, p, v in rows if (k, p) == ("hot", 0))
    cuts = sorted({base[math.ceil(i / 10 * len(base)) - 1] for i in range(1, 10)})
    place = lambda v: -1 if v is None else sum(c < bucket(v) for c in cuts)
    e, a = (Counter(place(v) for k, p, v in rows if (k, p) == ("hot", q)) for q in (0, 2))
    bins = set(e) | set(a)
    share = lambda c: {b: (c[b] + 0.5) / (sum(c.values()) + 0.5 * len(bins)) for b in bins}
    es, as_ = share(e), share(a)
    assert moved.psi == pytest.approx(sum((as_[b] - es[b]) * math.log(as_[b] / es[b]) for b in bins))
    js = sum(p[b] * math.log2(2 * p[b] / (es[b] + as_[b])) for b in bins for p in (es, as_)) / 2
    assert moved.js == pytest.approx(js) and 0 < moved.js < 1
    past, now = (sorted(bucket(v) for k, p, v in rows if (k, p) == ("hot", q) and v is not None) for q in (0, 2))
    ks = max(abs(sum(x <= b for x in past) / len(past) - sum(x <= b for x in now) / len(now)) for b in set(past) | set(now))
    assert moved.ks == pytest.approx(ks) and got["new", 1].reference_n == 0


def test_sketches_merge(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("key"), F.sin("id").alias("v"))
    parts = [D.sketches(rows.filter(f"pmod(hash(v), 2) = {i}"), ["key"], {"v": F.col("v")}) for i in (0, 1)]
    whole = D.sketches(rows, ["key"], {"v": F.col("v")})
    assert sorted(map(tuple, D.merged(*parts).collect())) == sorted(map(tuple, whole.collect()))


def test_category_drift(spark):
    rows = [(0, "a")] * 90 + [(0, None)] * 10 + [(1, "a")] * 50 + [(1, "b")] * 50
    got = D.categorical_drift(spark.createDataFrame(rows, "period int, v string"), [], "period", F.col("period") == 0, {"v": F.col("v")}).collect()
    e, a = [(n + 0.5) / 101.5 for n in (90, 10, 0)], [(n + 0.5) / 101.5 for n in (50, 0, 50)]
    assert len(got) == 1 and got[0].psi == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(e, a))) and got[0].verdict == "major"


@pytest.mark.parametrize("weighted", [False, True])
def test_samples_are_the_smallest_draws(spark, weighted):
    """A hot stratum, a tiny one and a null one; equal to a full sort, whatever the partitions."""
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 10 else rnd.choice(["x", None, "tiny"] if i < 300 else ["x", None]), float(rnd.randrange(0, 4))) for i in range(6000)]
    table = spark.createDataFrame(rows, "id long, stratum string, w double")
    draw = table.select("id", S.uniform(F.col("id"), 5).alias("u"))
    u = {r.id: r.u for r in draw.collect()}
    assert all(0 < x < 1 for x in u.values())
    priority = lambda r: -math.log(u[r[0]]) / (r[2] if weighted else 1.0)
    want = set()
    for stratum in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == stratum and (r[2] > 0 or not weighted)]
        want |= {r[0] for r in sorted(mine, key=lambda r: (priority(r), r[0]))[:25]}
    for parts in (1, 9):
        got = S.stratified_sample(table.repartition(parts), "id", ["stratum"], 25, F.col("w") if weighted else None, seed=5).collect()
        assert {r.id for r in got} == want and len(got) == len(want)
    if not weighted:
        total = Counter(r[1] for r in rows)
        assert sum(r.represents for r in got if r.stratum == "hot") == pytest.approx(total["hot"])


def test_samples_merge(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7 % 3).alias("stratum"))
    parts = [S.stratified_sample(rows.filter(F.col("id") % 4 == i), "id", ["stratum"], 30) for i in range(4)]
    whole = {(r.id, r.stratum): r.represents for r in S.stratified_sample(rows, "id", ["stratum"], 30).collect()}
    got = {(r.id, r.stratum): r.represents for r in S.merged_sample(parts, "id", ["stratum"], 30).collect()}
    assert got == pytest.approx(whole)


def pagerank(edges, seeds, damping):
    nodes = {n for s, d, _ in edges for n in (s, d)} | set(seeds)
    out = Counter()
    for s, _, w in edges:
        out[s] += w
    total = sum(seeds.values())
    home = {n: seeds.get(n, 0) / total for n in nodes}
    rank = dict(home)
    for _ in range(300):
        flow, stay = Counter(), 0.0
        for s, d, w in edges:
            flow[d] += damping * rank[s] * w / out[s]
        stay = 1 - sum(flow.values())
        rank = {n: flow[n] + home[n] * stay for n in nodes}
    return rank


def test_pagerank_with_a_hot_node_and_dead_ends(spark):
    rnd = random.Random(6)
    edges = [("hub", f"n{i}", 1.0) for i in range(300)] + [(f"n{i}", "hub", 2.0) for i in range(0, 300, 3)]
    edges += [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}", rnd.random()) for _ in range(500)] + [("n1", "end", 5.0), ("n1", "end", 1.0), ("lost", "end", 1.0)]
    seeds = {"one": {"n1": 1.0}, "two": {"n2": 3.0, "hub": 1.0, "alone": 1.0}}
    table = spark.createDataFrame(edges + [("n1", "zero", 0.0)], "src string, dst string, weight double")
    given = spark.createDataFrame([(w, n, x) for w, s in seeds.items() for n, x in s.items()], "walk string, node string, weight double")
    got = {}
    for r in G.personalized_pagerank(table, given, damping=0.8, tolerance=1e-10).collect():
        got.setdefault(r.walk, {})[r.node] = r.rank
    for walk, start in seeds.items():
        want = {n: x for n, x in pagerank(edges, start, 0.8).items() if x > 0}
        assert got[walk] == pytest.approx(want, abs=1e-9) and sum(got[walk].values()) == pytest.approx(1)
    assert "lost" not in got["one"]


def test_pagerank_joins_a_row_per_node_not_per_edge_and_walk(spark, monkeypatch):
    """Twenty walks over a hub of 3,000 edges: three blocks of walks, and a step's tables are as long as the nodes."""
    edges = [("hub", f"n{i}", 1.0 + i % 3) for i in range(3000)] + [(f"n{i}", "hub", 1.0) for i in range(0, 3000, 2)]
    seeds = {f"w{i}": {f"n{i}": 1.0, f"n{i + 1}": 2.0} for i in range(20)}
    kept, written = {}, G.written
    monkeypatch.setattr(G, "written", lambda df, name: kept.setdefault(name, []).append(written(df, name)) or kept[name][-1])
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    given = spark.createDataFrame([(w, n, x) for w, s in seeds.items() for n, x in s.items()], "walk string, node string, weight double")
    got = {}
    for r in G.personalized_pagerank(table, given, damping=0.5).collect():
        got.setdefault(r.walk, {})[r.node] = r.rank
    for walk in ("w0", "w7", "w8", "w19"):
        assert got[walk] == pytest.approx({n: x for n, x in pagerank(edges, seeds[walk], 0.5).items() if x > 0}, abs=1e-8)
    assert len(got) == 20
    # 1,501 nodes have edges, the hub some rows of them; before, a row for each of 4,500 edges and 3,001 nodes
    assert kept["transitions"][0].count() < 1520
    assert kept["visits"][-1].count() <= 3 * 3001


def test_metapaths_and_degrees(spark):
    edges = [("a", "x", "likes", 1.0), ("a", "y", "likes", 2.0), ("b", "x", "likes", 1.0), ("x", "p", "in", 3.0), ("x", "q", "in", 1.0), ("y", "p", "in", 0.5), ("a", "p", "in", 9.0)]
    table = spark.createDataFrame(edges, "src string, dst string, kind string, weight double")
    assert {r.node: r.paths for r in G.metapath_degrees(table, ["likes", "in"]).collect()} == {"a": 5.0, "b": 4.0}
    got = {(r.node, r.kind): (r.out_degree, r.in_degree, r.out_weight, r.in_weight) for r in G.degrees(table).collect()}
    assert got["x", "likes"] == (0, 2, 0.0, 2.0) and got["x", "in"] == (2, 0, 4.0, 0.0) and got["p", "in"] == (0, 3, 0.0, 12.5)


def test_edges_decay(spark):
    rows = [("a", "b", "k", 0.0), ("a", "b", "k", 10.0), ("a", "b", "k", -5.0), (None, "b", "k", 0.0), ("a", "c", "m", 20.0)]
    table = spark.createDataFrame(rows, "s string, d string, kind string, age double")
    got = G.decayed_edges(table, F.col("s"), F.col("d"), F.col("kind"), F.col("age"), 10.0, {"k": 2.0})
    assert {(r.src, r.dst, r.kind): r.weight for r in got.collect()} == {("a", "b", "k"): 5.0, ("a", "c", "m"): 0.25}
