import dataclasses
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.llm import quality as Q

SMALL = Q.Training(sample=200, buckets=1 << 12, dims=4, epochs=6)


def features(words, model):
    """Feature buckets of a text, word by word."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        return x ^ x >> 33

    out, whole = [], []
    for w in words:
        raw = b"<" + w + b">"
        for n in range(model.shortest, model.longest + 1):
            for i in range(len(raw) - n + 1):
                h = 0
                for c in raw[i : i + n]:
                    h = h * 0x100000001B3 + c + 1 & mask
                if n != len(raw):
                    out.append(mixed(h + (n << 56) & mask) % model.buckets)
        h = sum((c + 1) * pow(0x100000001B3, i + 1, 1 << 64) for i, c in enumerate(raw)) & mask
        out.append(mixed(h + (255 << 56) & mask) % model.buckets)
        whole.append(h)
    return out + [0 if a == b and model.share_repeats else mixed(a * 0x9E3779B97F4A7C15 + b & mask) % model.buckets for a, b in zip(whole, whole[1:])]


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("text", [b"", b"a", b"ab ab ab c", "été über x".encode(), b"word " * 30 + b"other"])
def test_scores_are_the_average_of_shares(text, shared):
    model = dataclasses.replace(SMALL, share_repeats=shared)
    shares = np.random.default_rng(1).normal(size=SMALL.buckets + 1)
    found = features(text.split(), model)
    want = (sum(shares[f] for f in found) / len(found) if found else 0.0) + shares[-1]
    scorer = Q.Scorer(shares, model)
    assert scorer.scores([b"warm up words", text])[1] == pytest.approx(1 / (1 + math.exp(-want)))
    keys, counts = Q.bag(text, model)
    assert {int(k): int(c) for k, c in zip(keys, counts)} == {f: found.count(f) for f in set(found)}


def test_learns_what_labels_mark(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["river", "stone", "light", "after"]) + rnd.choice(["", "s", "ing"]) for _ in range(40))
    bad = [
        lambda: " ".join(x.upper() + "!!" for x in good().split()),
        lambda: " ".join(x + "***" for x in good().split()),
        lambda: good().split()[0] + " " + "spam " * 39,
    ]
    rows = [(i, good() if i % 3 else bad[i % 9 // 3](), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    # labels of held-out rows are wrong on purpose: they must not be seen
    labels = spark.createDataFrame(
        [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in rows] + [(5000, 1), (None, 0), (7, None)], "doc_id long, quality int"
    )
    shares = Q.fit(docs, labels, SMALL)
    assert (shares == Q.fit(docs, labels, SMALL)).all()
    got = {r.doc_id: r for r in Q.score(docs.withColumn("score", F.lit("x")), shares, SMALL).withColumn("out", Q.held_out(F.col("doc_id"))).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    assert all(got[i].out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = Q.score(docs.join(labels, "doc_id").filter(Q.held_out(F.col("doc_id"))), Q.fit(docs, labels)).collect()
    assert len(scored) > 50 and sum(r.predicted == r.quality for r in scored) >= 0.97 * len(scored)


def test_awkward_rows(messy, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    shares = Q.fit(messy, labels, SMALL)
    rows = Q.score(messy, shares, SMALL)
    assert rows.columns == [c for c in messy.columns if c != "score"] + ["score", "predicted"]
    assert {(r.score, r.predicted) for r in rows.collect()} == {(0.5, 0)}
    assert Q.score(none, shares, SMALL).count() == 0
