import re

import pytest

from postsignal.llm import substring_dedup as P


def brute(rows):
    """(id, words, removed, kept) by looking at every window."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        if i is not None:
            for s in range(len(words) - 49):
                key = tuple(words[s : s + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - 49):
            if i is not None and first[tuple(words[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check_factors(got, rows):
    """Factors cover what the spans cover, and their words stand at the named place of a smaller id."""
    words = {}
    for i, text in rows:
        words.setdefault(i, []).append((text or "").split())
    for r in got:
        covered = {k for f in r.factors for k in range(f.start, f.stop)}
        assert covered == {k for s in r.spans for k in range(s.start, s.stop)}
        for f in r.factors:
            assert f.stop - f.start >= 50 and f.reference < r.doc_id
            sources = {tuple(w[f.place : f.place + f.stop - f.start]) for w in words[f.reference]}
            assert any(tuple(w[f.start : f.stop]) in sources for w in words[r.doc_id] if len(w) == r.n_words)


@pytest.mark.parametrize("piece", [64, 1 << 18])
def test_removed_words_equal_brute_force(messy, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    got = P.remove_repeated_passages(messy).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute([(r.doc_id, r.text) for r in messy.collect()])
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    check_factors(got, [(r.doc_id, r.text) for r in messy.collect()])


def test_factors_across_boundaries(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [
        (1, " ".join(w[:80])),
        (2, " ".join(w[40:120])),
        (3, " ".join(w[:120])),  # 0-79 and 40-119 overlap in a window's length less ten
        (4, " ".join(w[100:149])),  # 49 words: shorter than a window
        (5, " ".join(w[100:150])),
        (6, " ".join(["x", *w[100:150], "y"])),
        (7, " ".join(w[:50] + w[60:110])),
        (8, " ".join(["a", "b"] * 60)),
        (9, " ".join(["b", "a"] * 60)),
    ]
    got = P.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)


@pytest.mark.parametrize("piece", [64, 1 << 18])
def test_factors_are_as_long_as_their_reference(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    a, b = ([f"{c}{i}" for i in range(400)] for c in "ab")
    rows = [
        (1, " ".join(a)),
        (2, " ".join(b)),
        (3, " ".join(["x", *a[30:330], "y", *b[100:160], *a[200:260]])),
        (4, " ".join(a[350:] + b)),
        (5, " ".join(a)),
    ]
    got = {r.doc_id: r for r in P.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check_factors(got.values(), rows)
    parsed = {i: [tuple(f) for f in r.factors] for i, r in got.items()}
    assert parsed == {
        1: [], 2: [],
        3: [(1, 301, 1, 30), (302, 362, 2, 100), (362, 422, 1, 200)],
        4: [(0, 50, 1, 350), (50, 450, 2, 0)],
        5: [(0, 400, 1, 0)],
    }


@pytest.mark.parametrize("third", [3, 55, 60])
def test_one_id_under_two_texts(spark, third):
    w = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(w[:60])), (2, " ".join(["x", *w[:58], "y"])), (2, " ".join(w[100 : 100 + third])), (2, None), (3, " ".join(w[100 : 100 + third])), (3, " ".join(w[:60]))]
    got = P.remove_repeated_passages(spark.createDataFrame(rows + rows[1:3], "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows + rows[1:3])


def test_empty_table(none):
    assert P.remove_repeated_passages(none).count() == 0
