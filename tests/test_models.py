"""Naive Bayes, evaluation, diverse lists and lifecycle plans against plain Python, with hot groups."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsignal.operators import bayes as B
from postsignal.operators import diversity as DV
from postsignal.operators import evaluation as E
from postsignal.operators import retention as RT
from postsignal.policies import DataClass, LifecyclePolicy


def test_bayes_equals_the_formula(spark):
    rnd = random.Random(1)
    texts = {i: Counter(rnd.choices(["the", f"w{rnd.randrange(8)}", f"x{i % 3}"], k=rnd.randrange(1, 9))) for i in range(60)}
    texts[98], texts[99] = Counter({"unseen": 4}), Counter()
    label = {i: "abc"[i % 3] for i in range(40)} | {40: None, 99: "a"}
    counts = spark.createDataFrame([(d, t, n) for d, c in texts.items() for t, n in c.items()], "doc int, term string, tf long")
    model = B.fit(counts, spark.createDataFrame(list(label.items()), "doc int, label string"), alpha=0.5)
    got = {(r.doc, r.label): r.probability for r in B.posteriors(model, counts, spark.createDataFrame([(d,) for d in texts], "doc int")).collect()}
    by = {c: Counter() for c in "abc"}
    for d, c in label.items():
        if c:
            by[c].update(texts[d])
    vocabulary = set().union(*by.values())
    docs = Counter(c for c in label.values() if c)
    for d, c in texts.items():
        logs = {x: math.log(docs[x] / sum(docs.values())) + sum(n * math.log((by[x][t] + 0.5) / (sum(by[x].values()) + 0.5 * len(vocabulary))) for t, n in c.items() if t in vocabulary) for x in "abc"}
        total = sum(math.exp(v - max(logs.values())) for v in logs.values())
        for x in "abc":
            assert got[d, x] == pytest.approx(math.exp(logs[x] - max(logs.values())) / total)


@pytest.mark.parametrize("sent", [300_000, 3, 1])
def test_bayes_takes_occurrences_that_bring_their_label(spark, monkeypatch, sent):
    """A row for each occurrence gives what counted terms give, however many terms are sent to the tasks."""
    rnd = random.Random(4)
    texts = {i: rnd.choices(["the", "the", f"w{rnd.randrange(9)}", f"x{i % 2}"], k=rnd.randrange(1, 9)) for i in range(40)}
    label = {i: i % 2 for i in range(30)}
    counted = spark.createDataFrame([(d, t, n) for d, c in texts.items() for t, n in Counter(c).items()], "doc int, term string, tf long")
    single = spark.createDataFrame([(d, t, 1, label.get(d)) for d, c in texts.items() for t in c], "doc int, term string, tf long, label int")
    labels, docs = spark.createDataFrame(list(label.items()), "doc int, label int"), spark.createDataFrame([(d,) for d in texts], "doc int")
    want = {(r.doc, r.label): r.probability for r in B.posteriors(B.fit(counted, labels), counted, docs).collect()}
    monkeypatch.setattr(B, "SENT_TERMS", sent)
    got = {(r.doc, r.label): r.probability for r in B.posteriors(B.fit(single, labels), single.drop("label"), docs).collect()}
    assert got == pytest.approx(want) and len(got) == 80
    none = B.fit(counted, labels.limit(0))
    assert B.posteriors(none, counted, docs).count() == 0


def test_ranking_metrics_with_ties_and_a_hot_query(spark):
    rnd = random.Random(2)
    rows = [("hot", i, float(rnd.randrange(5)), rnd.choice([0, 0, 0, 1, 2])) for i in range(900)]
    rows += [("late", i, float(-i), int(i == 30)) for i in range(60)] + [("none", 1, 1.0, 0), ("none", 2, None, None), ("one", 1, None, 3)]
    got = {r.q: r for r in E.ranking_metrics(spark.createDataFrame(rows, "q string, i int, s double, g int").repartition(7), "q", "i", "s", "g", k=5).collect()}
    for q in ("hot", "late", "none", "one"):
        mine = [(i, -math.inf if s is None else s, g or 0) for x, i, s, g in rows if x == q]
        order = sorted(mine, key=lambda r: (-r[1], r[0]))
        dcg = lambda rs: sum(g / math.log2(p + 2) for p, (_, _, g) in enumerate(rs[:5]))
        relevant, r = sum(g > 0 for _, _, g in mine), got[q]
        assert (r["items"], r.relevant, r.precision) == (len(mine), relevant, sum(g > 0 for _, _, g in order[:5]) / 5)
        if not relevant:
            assert (r.ndcg, r.recall, r.reciprocal_rank) == (None, None, None)
            continue
        assert r.ndcg == pytest.approx(dcg(order) / dcg(sorted(mine, key=lambda r: -r[2])))
        assert r.reciprocal_rank == pytest.approx(1 / (1 + [g > 0 for _, _, g in order].index(True)))
        assert r.recall == pytest.approx(sum(g > 0 for _, _, g in order[:5]) / relevant)


def test_calibration(spark):
    rows = [("a", 0.0, 0), ("a", 1.0, 1), ("a", 0.95, 0), ("a", 0.25, 1), ("a", 0.2, 0), ("a", None, 1), ("a", 1.5, 1), ("a", 0.3, None), ("b", 1.0, 0)]
    got = {r.s: r for r in E.calibration(spark.createDataFrame(rows, "s string, p double, y int"), ["s"], "p", "y").collect()}
    a = got["a"]
    assert a.n == 5 and a.brier == pytest.approx((0.95**2 + 0.75**2 + 0.04) / 5)
    # bins: [0], [0.2, 0.25], [0.95, 1.0]
    assert a.ece == pytest.approx((1 * 0 + 2 * abs(0.225 - 0.5) + 2 * abs(0.975 - 0.5)) / 5) and a.mce == pytest.approx(0.475)
    assert got["b"].log_loss == pytest.approx(-math.log(1e-15), rel=1e-3)


def test_diverse_lists(spark):
    rnd = random.Random(3)
    items = [(q, i, rnd.random(), [rnd.gauss(0, 1) for _ in range(4)]) for q, n in (("hot", 300), ("few", 2)) for i in range(n)]
    items += [("hot", 900, 0.5, [0.0] * 4), ("hot", 901, 0.9, [1.0, 0.0, 0.0, 0.0]), ("hot", 902, 0.9, [1.0, 0.0, 0.0, 0.0]), ("hot", 903, None, [1.0] * 4), ("hot", 904, 1.0, None)]
    got = DV.marginal_relevance(spark.createDataFrame(items, "query string, item int, relevance double, vector array<double>").repartition(5), 4, balance=0.6)
    found = {}
    for r in got.collect():
        found.setdefault(r.query, {})[r.place] = (r.item, r.score)

    def cosine(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    for q in ("hot", "few"):
        left = {i: (r, v) for x, i, r, v in items if x == q and r is not None and v is not None}
        taken = []
        for place in range(1, 5):
            score = lambda i: round(0.6 * left[i][0] - 0.4 * max((cosine(left[i][1], v) for v in taken), default=0.0), 9)
            if not left:
                assert place not in found[q]
                continue
            best = min(left, key=lambda i: (-score(i), i))
            assert found[q][place] == (best, pytest.approx(score(best), abs=1e-8))
            taken.append(left.pop(best)[1])


@pytest.mark.parametrize("disk", [100_000, 20_000, 3_000, 0])
def test_lifecycle_budgets(spark, disk):
    """A class holds most objects; three budgets, each on what the one before has left."""
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 8 else rnd.choice(["old", "plain", None]), rnd.randrange(0, 100), rnd.randrange(1000), rnd.choice([None, *range(50)]), rnd.random() < 0.1) for i in range(600)]
    rows += [(700, "hot", None, 1, 1, False), (701, "hot", -5, 1, 1, None), (702, "old", 50, None, 3, False)]
    policy = LifecyclePolicy((DataClass("hot", None, 12_000), DataClass("old", 300, None)), disk, 0.9, 0.5)
    objects = spark.createDataFrame(rows, "object_id int, data_class string, byte_size int, stored_at long, last_accessed long, pinned boolean").repartition(6)
    got = {r.object_id: r.reason for r in RT.lifecycle_plan(objects, 1000, policy).collect()}
    want, left = {}, []
    for i, c, size, stored, used, pinned in rows:
        if c == "old" and stored is not None and stored + 300 <= 1000 and not pinned:
            want[i] = "class_expired"
        else:
            left.append((used if used is not None else -math.inf, i, c, max(size or 0, 0), bool(pinned)))
    left.sort()
    hot = sum(s for _, _, c, s, _ in left if c == "hot")
    for _, i, c, size, pinned in left:
        if c == "hot" and not pinned and size and hot > 12_000:
            want[i] = "class_budget"
            hot -= size
    left = [r for r in left if r[1] not in want]
    total = sum(s for _, _, _, s, _ in left)
    if total > policy.high_bytes:
        for _, i, _, size, pinned in left:
            if not pinned and size and total > policy.low_bytes:
                want[i] = "disk_watermark"
                total -= size
    assert got == want


def test_previous_rows_across_chunks(spark):
    from postsignal.operators.ordered import with_previous

    rnd = random.Random(6)
    rows = [(i, "hot" if i % 20 else rnd.choice(["a", None]), rnd.randrange(400), rnd.choice([None, i])) for i in range(2000)]
    got = {r.i: (r.previous_i, r.previous_v) for r in with_previous(spark.createDataFrame(rows, "i int, k string, at int, v int").repartition(5), ["i", "v"], ["k"], ["at", "i"]).collect()}
    last = {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == (last.get(k, (None, None)) if k is not None else (None, None))
        last[k] = (i, v)
    assert len(got) == 2000


def test_beta_posteriors(spark):
    from postsignal.operators.learning import beta_posteriors

    rows = [("a", 1.0, 0.0), ("a", 0.0, 10.0), ("a", None, 1.0), ("b", 1.0, -5.0), ("b", 0.5, 20.0), ("c", None, None)]
    got = {r.s: r for r in beta_posteriors(spark.createDataFrame(rows, "s string, y double, age double"), "s", F.col("y"), F.col("age"), 10.0).collect()}
    assert (got["a"].n, got["a"].alpha, got["a"].beta) == (2, 3.0, 2.5) and (got["b"].alpha, got["b"].beta) == (3.125, 2.125) and "c" not in got
    assert got["a"].mean == pytest.approx(3 / 5.5) and got["a"].low == pytest.approx(3 / 5.5 - 1.645 * math.sqrt(3 * 2.5 / (5.5**2 * 6.5)))


def test_fused_ranks(spark):
    from postsignal.operators.retrieval import fused_ranks

    lists = [spark.createDataFrame(r, "query int, doc int, rank int") for r in ([(1, 5, 1), (1, 6, 2), (2, 5, 1)], [(1, 6, 1), (1, 7, 2)])]
    got = [tuple(r)[:2] + (r["rank"],) for r in fused_ranks(lists, 2).orderBy("query", "rank").collect()]
    assert got == [(1, 6, 1), (1, 5, 2), (2, 5, 1)]
