import random
import re
from collections import Counter

import pytest
import xxhash

from postsignal.llm import simhash_dedup as S
from postsignal.llm.graph import smallest_reachable


def print_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest node reachable from each, by search."""
    out, left = {}, set(nodes)
    for start in sorted(nodes):
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += [y for y in left if y not in out and linked(x, y)]
    return out


def test_groups_equal_brute_force(messy):
    rows = [(r.doc_id, print_of(r.text)) for r in messy.collect()]
    prints = {p for _, p in rows}
    root = components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for i, p in rows:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{p:016x}", least.get(root[p])) for i, p in rows)
    assert Counter(map(tuple, S.simhash_groups(messy).collect())) == want


@pytest.mark.parametrize("chunk", [3, 512])
def test_links_connect_what_is_near(spark, monkeypatch, chunk):
    # a cloud of near fingerprints, far more than a chunk of a posting list
    monkeypatch.setattr(S, "CHUNK", chunk)
    rnd = random.Random(2)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:3]:
        values |= {centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 4))) for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [tuple(r) for r in S.near_links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()]
    assert all(((x ^ y) & (1 << 64) - 1).bit_count() <= 4 for x, y in links)
    pairs = {frozenset(p) for p in links}
    assert components(signed, lambda x, y: frozenset((x, y)) in pairs) == components(
        signed, lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 4
    )


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(500, 500 + i) for i in range(1, 60)] + [(900, 901), (901, 902), (902, 900), (902, 2000)]
    links += [(700, 700), (41, 40)]
    random.Random(3).shuffle(links)
    got = dict(map(tuple, smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(42)} | {i: 500 for i in range(500, 560)} | {900: 900, 901: 900, 902: 900, 2000: 900}
    assert got == want


def test_one_stays_and_empty_table(messy, none):
    left = S.one_per_group(messy)
    groups = [r.component_id for r in S.simhash_groups(messy).collect()]
    assert left.columns == messy.columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(kept, key=str) == sorted(set(groups), key=str)
    assert S.simhash_groups(none).count() == 0 and S.one_per_group(none).count() == 0
