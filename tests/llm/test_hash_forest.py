import random

import numpy as np
from pyspark.sql import functions as F

from postsignal.llm import hash_forest as A

def asked():
    return F.col("vec_id") % 20 == 0



def exact(rows, k=5):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        near = (vectors * vectors[q]).sum(axis=1) / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -near)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(near[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_candidates_give_the_exact_answer(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(400, 440)]  # a group of copies, queries among them
    rows += [(500, [2 * x for x in rows[40][1]]), (501, [-x for x in rows[40][1]])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got, want = found(A.nearest(table, asked(), forest=A.Forest(block=64, queries=7, enough=1e9))), exact(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] or np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-15)
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-15)


def test_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 64))
    vectors = centres[rng.integers(0, 10, 3000)] * 0.6 + rng.normal(size=(3000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, want = found(A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), asked())), exact(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_candidates_share_the_longest_prefixes():
    forest = A.Forest(trees=3, bits=8, enough=0.5)
    vectors = np.random.default_rng(8).normal(size=(60, 5))
    strings, asked = A.strings(vectors, forest), A.strings(vectors[:4], forest)
    for q, places in enumerate(A.candidates(vectors, vectors[:4], forest)):
        common = np.array([[8 - int(a ^ b).bit_length() for a in tree] for tree, b in zip(strings, asked[:, q])])
        depth = max(d for d in range(9) if (common >= d).sum() >= 0.5 * 60)
        assert set(places) == set(np.flatnonzero((common >= depth).any(axis=0)))


def test_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (2, []),
            (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = A.nearest(table, asked()).collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got] == [(0, 1, 1, round(0.5**0.5, 9))]
    assert A.nearest(table.filter("false"), asked()).count() == 0
