import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from postsignal.llm import mixing as M


def targets(sizes, weights, share, most):
    """Share by weight; what stands above its cap stops, and the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in free}
        for s in over:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    goal = targets(sizes, weights, share, most)
    number = lambda i: int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16)
    below = {}
    for s, size in sizes.items():
        passes = math.floor(goal[s] / max(size, 1))
        rest, done, below[s] = goal[s] - passes * size, 0, (passes, 0)
        by_hash = Counter()
        for i, src, n in sized:
            if src == s and n:
                by_hash[number(i)] += n
        for h in sorted(by_hash):
            if rest > 0 and done + by_hash[h] >= rest:
                below[s] = (passes, h + 1 if (rest - done) * 2 >= by_hash[h] else h)
                break
            done += by_hash[h]
    return Counter((i, n, sizes[s], round(goal[s], 6), n * (below[s][0] + (number(i) < below[s][1]))) for i, s, n in sized)


@pytest.mark.parametrize("options", [{}, {"share": 0.4}, {"share": 2.0}, {"weights": (1,), "share": 1.0, "most": 3.0}])
def test_mix_equals_brute_force(messy, options):
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(messy, **options).collect())
    assert got == brute([(r.doc_id, r.text, r.source) for r in messy.collect()], **options)


def test_taken_is_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 7 % 3]) for i in range(3000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r, in zip(got):
        taken[r.source_size, r.target] += r.taken
        assert r.taken <= 2 * r["size"]
    assert len(taken) == 3 and all(abs(n - target) <= 25 for (_, target), n in taken.items())


def test_rows_as_often_as_taken(messy, none):
    plan = Counter()
    for r in M.mix(messy).collect():
        if r["size"]:
            plan[r.doc_id] += r.taken
    rows = M.mixed_rows(messy)
    got = Counter()
    for r in rows.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert rows.columns == messy.columns and +got == +plan
    assert M.mix(none).count() == 0 and M.mixed_rows(none).count() == 0


def test_sources_without_words(spark):
    rows = [(1, "", "a"), (2, None, "b"), (3, " ", None)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r["size"], r.source_size, r.target, r.taken) for r in got} == {(0, 0, 0.0, 0)}
