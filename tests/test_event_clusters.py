"""Event clusters against search, for hot keys, late posts and streams."""

import random

import pytest
from pyspark.sql import functions as F

from postsignal.operators import event_clusters as EC
from postsignal.operators import fingerprints as FP
from postsignal.operators import ordered
from postsignal.operators import rows as RW
from postsignal.streaming import clusters as SC

SCHEMA = "item long, keys array<string>, at long, source string"


def brute(rows, gap):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = {}
    for item, keys, at, _ in rows:
        for key in set(keys or []):
            if at is not None and key is not None:
                by_key.setdefault(key, []).append((at, item))
    for found in by_key.values():
        found.sort()
        for (a, x), (b, y) in zip(found, found[1:]):
            if b - a <= gap:
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def random_rows(seed, n=400, span=4000):
    rnd = random.Random(seed)
    rows = [(i, [f"k{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 3))], rnd.randrange(span), f"s{rnd.randrange(5)}") for i in range(n)]
    return rows + [(n, [], 5, "s"), (n + 1, None, 5, "s"), (n + 2, ["k1", None, "k1"], None, "s"), (n + 3, ["k1", None], 7, None)]


@pytest.mark.parametrize("gap", [0, 20, 90, 10_000])
def test_clusters_equal_search(spark, gap):
    rows = random_rows(gap)
    got = EC.event_clusters(spark.createDataFrame(rows, SCHEMA).repartition(5), "item", F.col("keys"), F.col("at"), gap)
    assert {r.item: r.cluster_id for r in got.collect()} == brute(rows, gap)


def test_a_hot_key_is_many_chunks(spark):
    """One key on nearly all posts: its sessions run across chunks, and no chunk holds it whole."""
    rows = [(i, ["hot"] + ["rare"] * (i % 50 == 0), i * 10 + 500 * (i // 700), "s") for i in range(3000)]
    posts = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spans = EC.keyed_posts(posts, "item", F.col("keys"), F.col("at"))
    sizes = [r["count"] for r in ordered.range_chunks(spans, ["key"], ("start", "end", "item")).groupBy("chunk").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes)
    placed = {(r.item, r.key): r.session for r in EC.with_sessions(spans, 10).collect()}
    for item, _, at, _ in rows:
        first = 700 * (item // 700)
        assert placed[item, "hot"] == rows[first][2]
    got = EC.event_clusters(posts, "item", F.col("keys"), F.col("at"), 10)
    assert {r.item: r.cluster_id for r in got.collect()} == brute(rows, 10)


def test_long_spans_cover_what_starts_inside(spark):
    spans = [(1, "a", 0, 100), (2, "a", 50, 60), (3, "a", 105, 106), (4, "a", 120, 121), (5, "b", 0, 0)]
    placed = EC.with_sessions(spark.createDataFrame(spans, "item long, key string, start long, end long"), 10)
    assert {r.item: r.session for r in placed.collect()} == {1: 0, 2: 0, 3: 0, 4: 120, 5: 0}


def test_facts(spark):
    rows = [(1, "x", 0), (1, "x", 1800), (1, "y", 7200), (1, None, 7100), (2, "z", 50)]
    got = {r.cluster_id: r for r in EC.cluster_facts(spark.createDataFrame(rows, "cluster_id long, source string, at long"), "source", "at").collect()}
    assert (got[1].posts, got[1].sources, got[1].first_at, got[1].last_at, got[1].velocity, got[1].peak, got[1].acceleration) == (4, 2, 0, 7200, 2.0, 2, 0.0)
    assert (got[2].posts, got[2].velocity, got[2].peak, got[2].acceleration) == (1, 1.0, 1, 0.0)


@pytest.mark.parametrize("order", ["time", "late"])
def test_stream_equals_batch(spark, tmp_path, order):
    """Batches in order of time, or shuffled so that late posts join clusters of earlier batches."""
    gap, rows = 60, random_rows(7, 240, 6000)
    dealt = sorted(rows, key=lambda r: r[2] or 0) if order == "time" else random.Random(1).sample(rows, len(rows))
    folder = str(tmp_path / "state")
    for batch in range(4):
        part = spark.createDataFrame(dealt[batch::4] if order == "late" else dealt[batch * 61 : batch * 61 + 61], SCHEMA)
        for _ in range(1 + (batch == 2)):  # one batch is repeated
            SC.store_posts(part, batch, folder, "item", F.col("keys"), F.col("at"), gap, ("source",))
    got = SC.read_clusters(spark, folder)
    assert {r.item: r.cluster_id for r in got.collect()} == brute(rows, gap)
    assert got.count() == len(rows)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_hot_key_stay_spread(spark, how):
    """A join by key alone would put the 4,000 rows of the hot key into one task."""
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7).alias("k")).repartition(8).localCheckpoint()
    facts = rows.filter("k <> 5").groupBy("k").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).localCheckpoint()
    got = RW.join_keyed(rows, facts, ["k"], how=how, hot=1000)
    largest = max(got.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"]
    assert largest < 1500
    want = rows.join(facts.drop("n"), ["k"], how)
    assert sorted(map(str, got.select("id", "k", "least").collect())) == sorted(map(str, want.select("id", "k", "least").collect()))


def test_huge_clusters_take_the_spread_join(spark, monkeypatch, tmp_path):
    """Links, components, facts and the stream's names, with every key of more than three rows as a hot one."""
    gap, rows, hot = 90, random_rows(3), []
    plain = RW.join_keyed

    def low(*args, **kwargs):
        hot.append(args[1].filter("n > 3").count())
        return plain(*args, **kwargs, hot=3)

    for module in (EC, FP, SC):
        monkeypatch.setattr(module, "join_keyed", low)
    posts = spark.createDataFrame(rows, SCHEMA)
    found = EC.event_clusters(posts, "item", F.col("keys"), F.col("at"), gap)
    assert {r.item: r.cluster_id for r in found.collect()} == brute(rows, gap)
    facts = EC.cluster_facts(found.join(posts, "item"), "source", "at")
    times = {}
    for item, root in brute(rows, gap).items():
        times.setdefault(root, []).append(rows[item][2])
    want = {root: (len(at), min((t for t in at if t is not None), default=None)) for root, at in times.items()}
    assert {r.cluster_id: (r.posts, r.first_at) for r in facts.collect()} == want
    folder = str(tmp_path / "state")
    for batch in range(3):
        SC.store_posts(spark.createDataFrame(rows[batch::3], SCHEMA), batch, folder, "item", F.col("keys"), F.col("at"), gap, ("source",))
    assert {r.item: r.cluster_id for r in SC.read_clusters(spark, folder).collect()} == brute(rows, gap)
    assert max(hot) > 0


def test_texts_are_fingerprinted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(item):
        seen.add(1)
        return item // 2

    rows = spark.range(100).select(F.col("id").alias("item"), F.lit("a").alias("algorithm"), F.udf(costly, "long")("id").alias("bits"))
    got = FP.cluster(rows, threshold=0, blocks=2)
    assert {r.item: r.cluster_id for r in got.collect()} == {i: i // 2 * 2 for i in range(100)}
    assert seen.value == 100
