"""The chosen-path join against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest
from conftest import prose

from postsignal.llm import chosen_path as C
from postsignal.llm import set_links


def shingles(text, words):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def brute_components(rows, words, percent):
    """Rows (id, text) -> list of (id, set size, smallest id reachable)."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            parent[find(i)] = find(first.setdefault(s, i))
    distinct = sorted(first.items(), key=lambda x: len(x[0]))
    for k, (s, i) in enumerate(distinct):
        for t, j in distinct[k + 1 :]:
            if 100 * len(s) < percent * len(t):
                break
            shared = len(s & t)
            if 100 * shared >= percent * (len(s) + len(t) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(rnd, size, words, changed, start=10_000):
    base = prose(rnd, words).split(" ")
    out = []
    for i in range(size):
        copy = list(base)
        for p in rnd.sample(range(words), changed):
            copy[p] = f"c{i}_{p}"
        out.append((start + i, " ".join(copy)))
    return out


def test_against_all_pairs(spark, messy):
    got = C.similar_sets(messy)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    want = brute_components([(r.doc_id, r.text) for r in messy.collect()], 3, 85)
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_kept_rows(spark, messy):
    kept = C.one_of_each(messy)
    assert kept.columns == messy.columns
    want = {r[0] for r in brute_components([(r.doc_id, r.text) for r in messy.collect()], 3, 85) if r[0] is not None and r[0] == r[2]}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


@pytest.mark.parametrize("changed, leaf", [(2, 512), (4, 512), (5, 64), (6, 32)])
def test_groups_around_the_threshold(spark, monkeypatch, changed, leaf):
    """Near copies of 200 words; pairs are at 0.89, 0.79, 0.75 and 0.70, but for places that coincide."""
    monkeypatch.setattr(C, "LEAF", leaf)
    monkeypatch.setattr(set_links, "CHUNK", 64)
    rnd = random.Random(changed)
    rows = near_copies(rnd, 300, 200, changed // 2 or 1) + near_copies(rnd, 300, 200, changed, 20_000)
    got = C.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_components(rows, 3, 85))


def test_pairs_at_the_threshold_are_found(spark):
    """Lone pairs just above 0.85, each of which only the trees can find."""
    rnd = random.Random(9)
    passage = prose(rnd, 60)
    rows = []
    for k in range(400):
        base = prose(rnd, 140).split(" ")
        a, b = list(base), list(base)
        for p in rnd.sample(range(10, 130), 3):
            b[p] = f"x{k}_{p}"
        rows += [(2 * k, " ".join(a) + " " + passage * (k % 2)), (2 * k + 1, " ".join(b) + " " + passage * (k % 2))]
    want = brute_components(rows, 3, 85)
    linked = {w[0] for w in want if w[0] != w[2]}
    assert len(linked) > 300
    got = C.similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)


def test_a_large_group_leaves_as_nodes(spark, monkeypatch):
    """Twice the near copies make about twice the rows between the steps."""
    monkeypatch.setattr(set_links, "CHUNK", 128)
    counts = {}
    for size in (400, 800):
        rows = near_copies(random.Random(4), size, 200, 3)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        made = []
        keep = set_links._pairs_kept
        monkeypatch.setattr(set_links, "_pairs_kept", lambda pairs, *a: made.append(pairs.count()) or keep(pairs, *a))
        C.similar_sets(docs).count()
        monkeypatch.setattr(set_links, "_pairs_kept", keep)
        counts[size] = sum(made)
    assert counts[800] < 2.6 * counts[400] and counts[800] < 30 * 800


def test_sketch_passes_what_it_must():
    rng = np.random.default_rng(1)
    a, b = set_links.permutations(C.POSITIONS)
    missed = 0
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, 75), dtype=np.uint64)
        p, q = (np.frombuffer(C.tokens_and_sketch(np.concatenate([shared, o]), a, b)[1], np.uint8) for o in own)
        missed += not C._alike(85)(p, q)
    assert missed == 0


def test_empty_table(spark, none):
    assert C.similar_sets(none).count() == 0 and C.one_of_each(none).count() == 0


def test_a_pair_of_several_groups_is_linked_in_one(spark):
    """Three nodes in groups 7 and 9, two of them alike, and a pair that only group 9 holds."""
    alike, apart = np.arange(40, dtype=np.uint64).tobytes(), np.arange(90, 130, dtype=np.uint64).tobytes()
    sets = {1: alike, 2: alike, 3: apart, 4: apart}
    rows = [
        (key, 0, 0, False, node, node, b"\0", sets[node], keys)
        for key, nodes in ((7, (1, 2, 3)), (9, (1, 2, 3, 4)))
        for node, keys in ((n, [7, 9] if n < 4 else [9]) for n in nodes)
    ]
    kinds = "key long, i int, j int, right boolean, node long, root long, sketch binary, set binary, keys array<long>"
    every = lambda p, q: (p == q).all(axis=-1)
    links = set_links._forests(spark.createDataFrame(rows, kinds), every, 85).collect()
    # in both groups, before: (1, 2) twice
    assert sorted((r["x"], r["y"]) for r in links) == [(1, 2), (3, 4)]
