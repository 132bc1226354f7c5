import random

import pytest
from test_simhash_dedup import components

import corpus_pipeline
from postsignal.llm import jaccard_dedup as J
from postsignal.llm import set_links


def shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(x, y):
    a, b = shingles(x), shingles(y)
    return 5 * len(a & b) >= 4 * len(a | b)


def near_copies(rnd, n=60):
    """Texts with copies that differ in one or two of 100 words: similarity 0.9 and 0.8."""
    out = []
    for _ in range(n):
        words = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        out.append(" ".join(words))
        for changed in (1, 2):
            copy = list(words)
            for k in rnd.sample(range(100), changed):
                copy[k] = f"v{rnd.randrange(5000)}"
            out.append(" ".join(copy))
    return out


def test_the_stage_drops_near_copies_of_one_or_two_words(spark):
    rows = list(enumerate(near_copies(random.Random(4))))
    texts = dict(rows)
    root = components(texts, lambda x, y: alike(texts[x], texts[y]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))


def test_simhash_alone_links_what_is_four_bits_apart(spark, monkeypatch):
    """Without the index of minima, the stage's links are those of SimHash that the exact sets confirm."""
    rnd, rows = random.Random(12), []
    for k in range(40):
        words = [f"w{rnd.randrange(50_000)}" for _ in range(600)]
        copy = list(words)
        copy[rnd.randrange(600)] = f"v{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    monkeypatch.setattr(set_links, "leader_pairs", lambda entries, nodes, *a: nodes.selectExpr("node x", "node y").limit(0))
    monkeypatch.setattr(set_links, "cross_links", lambda entries, nodes, *a: nodes.selectExpr("node x", "node y").limit(0))
    got = {r.doc_id: r.root for r in J.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bits = {i: int.from_bytes(J.simhash(set_links.shingle_hashes(set_links.words_of(t.encode()), 5)), "big") for i, t in rows}
    texts = dict(rows)
    root = components(texts, lambda x, y: (bits[x] ^ bits[y]).bit_count() <= 4 and alike(texts[x], texts[y]))
    assert len(set(root.values())) <= 50
    assert len(set(zip(got.values(), (root[i] for i in got)))) == len(set(root.values())) == len(set(got.values()))


@pytest.mark.parametrize("chunk", [3, 512])
def test_groups_equal_brute_force(spark, messy, monkeypatch, chunk):
    monkeypatch.setattr(set_links, "CHUNK", chunk)
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    rnd = random.Random(6)
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):  # neighbours are near, the ends are not
        chain[rnd.randrange(60)] = f"d{i}"
        rows.append((1000 + i, " ".join(chain)))
    texts = {t or "" for _, t in rows}
    root = components(texts, alike)
    least = {}
    for i, t in rows:
        r = root[t or ""]
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    want = sorted((None if none else i for none, i in least.values()), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in J.one_of_similar(docs).collect()), key=str) == want


def group_at_the_threshold(size):
    """Copies of a 300-word text with four words changed: pairs lie on both sides of 0.8."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    out = []
    for i in range(size):
        copy = list(base)
        for k in rnd.sample(range(300), 4 if i % 3 else 6):
            copy[k] = f"v{i}_{k}"
        out.append((i, " ".join(copy)))
    return out


def test_a_group_leaves_no_pairs(spark, monkeypatch):
    """Twice the near copies at the threshold make at most about twice the rows between the steps; no link is lost."""
    counts, keep, step = {}, set_links._pairs_kept, set_links._by_group
    for size in (150, 300):
        rows, made = group_at_the_threshold(size), []
        monkeypatch.setattr(set_links, "_pairs_kept", lambda pairs, *a: made.append(pairs.count()) or keep(pairs, *a))
        monkeypatch.setattr(set_links, "_by_group", lambda pairs, *a: made.append(pairs.count()) or step(pairs, *a))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.root for r in J.similar_groups(docs).collect()}
        texts = dict(rows)
        root = components(texts, lambda x, y: alike(texts[x], texts[y]))
        assert len(set(zip(got.values(), (root[i] for i in got)))) == len(set(root.values())) == len(set(got.values()))
        counts[size] = sum(made)
    assert counts[300] <= 2.5 * counts[150]


def test_clashing_and_missing_columns(spark, messy, none):
    left = J.one_of_similar(messy)
    assert left.columns == messy.columns
    twice = J.one_of_similar(messy.union(messy))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in twice.collect())
    assert J.one_of_similar(none).count() == 0 and J.one_of_similar(none).columns == none.columns


def test_recall_against_all_pairs(spark):
    """Lone pairs of similarity 0.8 to 0.83: at least 99 of 100 are linked."""
    rnd, rows = random.Random(8), []
    for k in range(500):
        words = [f"w{rnd.randrange(50_000)}" for _ in range(98)]
        copy = list(words)
        for p in (20 + rnd.randrange(10), 60 + rnd.randrange(10)):
            copy[p] = f"v{k}_{p}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    near = [k for k in range(500) if alike(rows[2 * k][1], rows[2 * k + 1][1])]
    got = {r.doc_id: r.root for r in J.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) == 500 and sum(got[2 * k] == got[2 * k + 1] for k in near) >= 495
