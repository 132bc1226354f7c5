import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsignal.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("shift", [0, 3, 11])
def test_rice_codes_come_back(shift):
    rnd = random.Random(shift)
    for n in (0, 1, 2, 500):
        values = np.array(sorted(rnd.randrange(1 << 14) for _ in range(n)), np.uint64)
        unary, low = X.rice_encode(values, shift)
        assert X.rice_decode(unary, low, n, shift).tolist() == values.tolist()


def test_codes_are_short():
    rnd = random.Random(1)
    values = np.array(sorted(rnd.randrange(1 << 24) for _ in range(1 << 14)), np.uint64)
    assert sum(map(len, X.rice_encode(values, 9))) < 1.6 * len(values)


def test_groups_equal_brute_force(messy):
    got = [tuple(r) for r in X.exact_groups(messy).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in messy.collect()])


def test_equal_bits_are_not_equal_texts(spark, monkeypatch):
    # with every document a suspect, only the comparison of bytes decides
    monkeypatch.setattr(X, "_is_set", lambda bitmap, bit: F.lit(True))
    rows = [(i, f"text {i // 2}") for i in range(60)]
    got = X.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)


def test_bitmaps_mark_what_occurs_twice(spark):
    values = list(range(-500, 500)) + [7, 7, -3]
    hashes = spark.createDataFrame([(v * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63),) for v in values], "h long")
    marks = X.duplicate_bitmaps(hashes, len(values)).collect()
    assert sum(bin(int.from_bytes(r.bitmap, "big")).count("1") for r in marks) == 2


def test_survivors_and_empty_table(messy, none):
    left = X.survivors(messy)
    assert left.columns == messy.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in messy.collect()})
    assert X.exact_groups(none).count() == 0 and X.survivors(none).count() == 0


def test_a_text_on_nearly_all_rows(spark):
    """A batch sends no value more than twice, so the owner of a hot text decodes a few entries a batch."""
    texts = spark.range(20_000).selectExpr("id as doc_id", "case when id % 100 = 0 then concat('own ', id) else 'hot' end as text").repartition(4)
    hashes = texts.select(X.text_key(texts.text).alias("_hash"))
    coded = hashes.mapInArrow(X._sender(30, 4), "owner long, count int, shift int, unary binary, low binary")
    assert coded.agg({"count": "sum"}).first()[0] <= 200 + 2 * 4
    got = X.exact_groups(texts).groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, True, 200), (19_800, False, 19_799), (19_800, True, 1)]
    assert X.filter_bits(0) == X.LEAST_BITS and X.filter_bits(1 << 20) == 23 and X.filter_bits(10**12) == X.MOST_BITS
