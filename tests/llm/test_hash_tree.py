import math
import zlib
from collections import Counter

import xxhash

from postsignal.llm import hash_tree as H


def draw(key, child):
    h = xxhash.xxh64_intdigest(child.name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return -math.log(((h >> 11) + 0.5) / 2.0**53) / child.weight


def place(key, node):
    while node.shard is None:
        node = min(node.children, key=lambda c: draw(key, c)) if len(node.children) > 1 else node.children[0]
    return node.shard


def test_rows_equal_brute_force(messy, monkeypatch):
    monkeypatch.setattr(H, "NUMBERED", 3)
    root = H.tree([1.0] * 16)
    got = H.shard_rows(messy, root).collect()
    want = Counter()
    for r in messy.collect():
        key, raw = "" if r.doc_id is None else str(r.doc_id), (r.text or "").encode()
        want[(r.doc_id, len(raw) + 1, zlib.crc32(raw), "key", place(key, root), place(key, H.grown(root)))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_law_and_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    root = H.tree([1.0] * 15 + [3.0])
    got = H.shard_rows(docs, root).collect()
    counts = Counter(r.shard for r in got)
    assert all(abs(n - 20_000 * (3 if s == 15 else 1) / 18) < 6 * math.sqrt(n) for s, n in counts.items())
    moved = [r for r in got if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 16 for r in moved) and abs(len(moved) - 20_000 / 19) < 200
    # a rack that grows takes rows into its region only; inside other regions nothing moves
    heavier = H.tree([2.0] + [1.0] * 14 + [3.0])
    changed = [(r.shard, place(str(r.doc_id), heavier)) for r in got[:4000]]
    first = {leaf.shard for rack in root.children[0].children for leaf in rack.children}
    assert all(a == b or b in first for a, b in changed)


def test_small_trees_and_empty_table(none, messy):
    assert H.shard_rows(none, H.tree([1.0] * 16)).count() == 0
    only = H.shard_rows(messy, H.tree([1.0]), grow=None).collect()
    assert {r.shard for r in only} == {0} and {r.grown_shard for r in only} == {None}
    assert sorted(r.slot for r in only) == list(range(messy.count()))
