import random

import pytest
from pyspark.sql import functions as F

from postsignal.functions.scores import feedback_reward
from postsignal.operators import learning as L
from postsignal.operators import ordered as O
from postsignal.operators import retention as RT
from postsignal.policies import RetentionPolicy, ThrottlePolicy


def skewed(n, seed):
    """Rows of which more than a third share one key and many share the sort key."""
    rnd = random.Random(seed)
    return [(("hot" if rnd.random() < 0.6 else rnd.choice("abc")), rnd.randrange(n // 4), i, rnd.randrange(-5, 9)) for i in range(n)]


def test_running_sum_and_position(spark):
    rows = skewed(400, 1)
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)
    got = {r["id"]: (r["before"], r["pos"]) for r in O.with_position(
        O.with_running_sum(df, "v", "before", ["t", "id"], ["k"]), ["k"], ["t", "id"], "pos").collect()}
    sums, pos = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == (sums.get(k, 0), pos.get(k, 0))
        sums[k], pos[k] = sums.get(k, 0) + v, pos.get(k, 0) + 1
    total = {r["id"]: r["before"] for r in O.with_running_sum(df, "v", "before", ["t", "id"]).collect()}
    acc = 0
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert total[i] == acc
        acc += v


def test_fold_equals_sequential_clamping(spark):
    rows = skewed(500, 2)
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(5)
    out = O.fold_clamped(df, "k", ["t", "id"], F.lit(0.9), F.col("v") / 7.0, -0.5, 1.5, seed_value=1.0)
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = max(-0.5, min(1.5, 0.9 * want.get(k, 1.0) + v / 7.0))
    got = {r["k"]: r["value"] for r in out.collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_weights_example(spark):
    rows = [(1, "approved"), (2, "rejected"), (3, "edited"), (4, "unheard of")]
    df = spark.createDataFrame(rows, "event_id int, action string").withColumn("variant_label", F.lit("reaction")).withColumn("ts", F.lit(0))
    got = L.folded_weights(L.rewarded_feedback(df)).first()
    assert (got["key"], got["steps"]) == ("tone.reaction", 4)
    assert got["value"] == pytest.approx(1.02)
    other = spark.createDataFrame([("reject",), ("posted_manually",)], "a string").select(feedback_reward(F.col("a")).alias("r"))
    assert [r["r"] for r in other.collect()] == [0.0, 1.2]


def test_throttle_equals_one_bucket_per_key(spark):
    for seed, policy in [(1, ThrottlePolicy(3, 0.4, 1)), (2, ThrottlePolicy(2.5, 0.9, 1.2)), (3, ThrottlePolicy(1, 5, 2))]:
        rnd = random.Random(seed)
        rows = sorted((rnd.randrange(300) * 1_000_000, i, "hot" if rnd.random() < 0.7 else rnd.choice("ab")) for i in range(400))
        df = spark.createDataFrame(rows, "us long, id int, k string").repartition(6)
        got = {r["id"]: r["admitted"] for r in L.throttle(df, "k", "us", "id", policy).collect()}
        state, want = {}, {}
        for us, i, k in rows:
            flags, *state[k] = L.take_tokens([us], *state.get(k, (None, None)), policy)
            want[i] = flags[0]
        assert got == want


def test_bucket_response_stays_small_and_exact():
    rnd = random.Random(9)
    for policy in (ThrottlePolicy(3, 0.25, 1), ThrottlePolicy(60, 10, 1), ThrottlePolicy(10, 0.5, 4)):
        micros = sorted(rnd.randrange(4_000) * 250_000 for _ in range(600))
        pieces = L.bucket_response(micros, 0, policy)
        assert len(pieces) <= policy.capacity / policy.cost + 3
        for start in (0.0, 0.3, 1.0, 2.75, policy.capacity):
            _, want, _ = L.take_tokens(micros, start, 0, policy)
            low, slope, offset = [p for p in pieces if p[0] <= start][-1]
            assert slope * start + offset == pytest.approx(want)


def test_throttle_parameters():
    with pytest.raises(ValueError):
        ThrottlePolicy(capacity=0)


OBJECT = "sha string, byte_size long, reference_count int, storage_policy string, last_accessed long, expires_at long"


def test_retention_example(spark):
    rows = [("a", 25, 0, "thumbnail", 100, None), ("b", 20, 0, "thumbnail", 200, None), ("c", 30, 0, "original", 50, None), ("z", 0, 0, "x", 1, 1)]
    df = spark.createDataFrame(rows, OBJECT)
    policy = RetentionPolicy(max_bytes=75, min_free_bytes=21)
    plan = RT.retention_plan(df, 1_000, policy)
    assert [(r["sha"], r["reason"]) for r in plan.collect()] == [("a", "quota_unreferenced")]
    t = RT.retention_totals(df, plan, policy).first()
    assert (t["total_bytes_after"], t["protected_files"], t["remaining_files"], t["target_bytes"]) == (50, 1, 3, 54)


def test_retention_equals_walking_the_list(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = [
            (f"{i:02}", rnd.randrange(0, 9), rnd.randrange(2), rnd.choice(["original", "thumbnail"]), rnd.randrange(5), rnd.choice([None, 5, 50]))
            for i in range(60)
        ]
        policy, now = RetentionPolicy(rnd.randrange(20, 250)), 10
        entries = [r for r in rows if r[1] > 0]
        total = sum(r[1] for r in entries)
        dead = {r[0] for r in entries if r[5] is not None and r[5] <= now}
        cand = sorted((r for r in entries if r[0] in dead or (r[2] == 0 and r[3] != "original")), key=lambda r: (r[0] not in dead, r[4], r[0]))
        freed, want = 0, []
        for r in cand:
            if r[0] not in dead and total - freed <= policy.target_bytes:
                break
            want.append(r[0])
            freed += r[1]
        got = RT.retention_plan(spark.createDataFrame(rows, OBJECT), now, policy).collect()
        assert sorted(r["sha"] for r in got) == sorted(want)


def test_reliability_and_choices(spark):
    obs = spark.createDataFrame([("s", 100.0, 1), ("s", 0.0, 2), ("t", 500.0, 1)], "source string, observed double, ordinal int")
    src = spark.createDataFrame([("s", "Journalist")], "source string, source_type string")
    got = {r["source"]: r["value"] for r in L.folded_reliability(obs, src).collect()}
    assert got == {"s": pytest.approx((75 * 0.85 + 15) * 0.85), "t": pytest.approx(100.0)}
    opts = spark.createDataFrame([("k", "a", 0, None), ("k", "b", 1, 0.0), ("l", "a", 0, 1.0), ("l", "b", 1, 2.0)], "key string, option string, ordinal int, score double")
    assert {r["key"]: r["choice"] for r in L.choose_options(opts).collect()} == {"k": "a", "l": "b"}
    assert all(r["explored"] for r in L.choose_options(opts, epsilon=1.0).collect())


def test_fold_of_one_hot_key(spark, monkeypatch):
    """Nearly all rows under one key, cut into many short lists."""
    from postsignal.operators import ordered as O

    monkeypatch.setattr(O, "FOLDED", 7)
    monkeypatch.setattr(O, "CHUNK_ROWS", 40)
    rnd = random.Random(9)
    rows = [("hot" if i % 100 else "rare", i, rnd.uniform(-3, 3)) for i in range(2_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, step double")
    got = {r["key"]: (r["value"], r["steps"]) for r in O.fold_clamped(df, "key", ["at"], F.lit(0.9), F.col("step"), -4.0, 4.0).collect()}
    want = {}
    for key, _, step in sorted(rows, key=lambda r: r[1]):
        value, n = want.get(key, (1.0, 0))
        want[key] = (max(-4.0, min(4.0, 0.9 * value + step)), n + 1)
    assert got == {k: (pytest.approx(v), n) for k, (v, n) in want.items()}


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from postsignal import runtime

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Cluster)


def test_previous_text_across_stretches(spark, monkeypatch):
    from postsignal.operators import lookups as J

    monkeypatch.setattr(J, "STRETCH", 4)
    rows = [("a", t, f"t{t}" if t % 3 else None) for t in (0, 1, 3, 4, 9, 10, 11, 23)] + [("b", 7, "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r["quoted_text"] for r in J.with_previous_text(df).collect()}
    want = {("b", 7): ""}
    for (c, t, _), (_, _, before) in zip(rows[:8], [("a", 0, None), *rows[:7]]):
        want[c, t] = before or ""
    assert got == want


def test_lexicon_table_beyond_any_limit(spark):
    """6,000 terms of 1 to 9 characters; hits equal a plain search."""
    from postsignal.operators import lookups as J

    rnd = random.Random(4)
    letters = "abcdé ş"
    terms = [(f"c{i % 9}", "".join(rnd.choice(letters) for _ in range(rnd.choice([5, 6, 9, 9])))) for i in range(6_000)]
    terms += [("short", "é"), ("short", "zz"), ("Case", "ABC"), ("none", "not there"), ("empty", "")]
    texts = [(i, "".join(rnd.choice(letters + "AB") for _ in range(rnd.randrange(60)))) for i in range(60)] + [(60, None), (61, "zz")]
    posts = spark.createDataFrame(texts, "id int, text string")
    got = {(r["id"], r["category"]) for r in J.tag_with_terms(posts, spark.createDataFrame(terms, "category string, term string"), ["id"]).collect()}
    assert got == {(i, c) for i, t in texts for c, k in terms if k and k.lower() in (t or "").lower()}
    assert J.tag_with_terms(posts, spark.createDataFrame([], "category string, term string"), ["id"]).count() == 0
