import math
from collections import defaultdict

import pytest

from postsignal.llm import host_reputation as R

RULES = [R.Rule("allow", "org"), R.Rule("block", "example.org", "/es/"), R.Rule("block", "example.org", "/en/1"), R.Rule("block", "a.b.net", "/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:stop]


def shrink(counts, rates, policy):
    beyond = sum((g - n * p) ** 2 - n * p * (1 - p) for (g, n), p in ((counts[k], rates[k]) for k in counts))
    pairs = sum(n * (n - 1) * p * (1 - p) for (g, n), p in ((counts[k], rates[k]) for k in counts))
    rho = beyond / pairs if pairs else 0
    strength = min(max(1 / rho - 1, policy.strength[0]), policy.strength[1]) if rho > 0 else policy.strength[1]
    return {k: (strength * rates[k] + g, strength * (1 - rates[k]) + n - g) for k, (g, n) in counts.items()}


def brute(pages, outcomes, policy):
    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    sums = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    total = [0, 0]
    for url, good in outcomes:
        if good is not None:
            h = split(url)[0]
            for s in (sums[0][h], sums[1][domain(h)], sums[2][suffix(h)], total):
                s[0] += good
                s[1] += 1
    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    top = (policy.first[0] + total[0], policy.first[1] + total[1] - total[0])
    suffixes = shrink(sums[2], {k: mean(top) for k in sums[2]}, policy)
    domains = shrink(sums[1], {k: mean(suffixes[suffix(k)]) for k in sums[1]}, policy)
    hosts = shrink(sums[0], {k: mean(domains[domain(k)]) for k in sums[0]}, policy)
    out = []
    for i, url in pages:
        host, path = split(url)
        a, b = hosts.get(host) or domains.get(domain(host)) or suffixes.get(suffix(host)) or top
        bound = a / (a + b) - policy.z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        verdict = rule.verdict if rule else "allow" if bound >= policy.limit else "block"
        out.append((i, host, path, rule and rule.text, verdict, round(bound, 9)))
    return sorted(out, key=str)


URLS = [
    None, "", "no scheme/x", "http://", "HTTP://A.B.Net", "http://a.b.net/x?y#z", "https://EXAMPLE.org/es/1", "http://x.example.org/en/12",
    "http://x.example.org/en/2", "http://notexample.org/es/", "http://q.com?u=http://z.org/", "http://q.com#f", "http://q.com/p//r://s?", "http://ÄB.com/",
    "http://good.net/1", "http://m.good.net/2", "http://bad.net/1", "http://new.bad.net/", "http://org", "http://solo", "://q.com/fr/",
]


@pytest.mark.parametrize("policy", [R.Policy(), R.Policy(limit=0.5, z=2.0, strength=(2.0, 20.0), first=(3.0, 1.0))])
def test_verdicts_equal_brute_force(spark, policy):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (3, URLS[3]), (3, URLS[3])]
    outcomes = [("http://good.net/a", 1)] * 9 + [("http://m.good.net/b", 1)] * 3 + [("http://bad.net/c", 0)] * 8 + [("http://bad.net/d", 1)]
    outcomes += [("http://q.com", None), (None, 1), ("http://q.com/1", 1), ("http://q.com/2", 0), ("http://w.com/2", 0)]
    table = spark.createDataFrame([(i, u, "x", 1.0) for i, u in pages], "page_id long, url string, host string, bound double")
    got = R.judge_urls(table, spark.createDataFrame(outcomes, "url string, good int"), RULES, policy).collect()
    assert sorted(((*r[:5], round(r.bound, 9)) for r in got), key=str) == brute(pages, outcomes, policy)


def test_no_outcomes_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string, good int")
    row = R.judge_urls(pages, nothing).first()
    assert row.verdict == "block" and math.isclose(row.bound, 0.5 - math.sqrt(1 / 12))
    assert R.judge_urls(pages.filter("false"), nothing).count() == 0


def test_suffixes_of_several_labels(spark):
    hosts = {
        "a.foo.co.uk": ("foo.co.uk", "co.uk"), "foo.co.uk": ("foo.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "xco.uk": ("xco.uk", "uk"), "b.c.example.com": ("example.com", "com"),
        "me.github.io": ("me.github.io", "github.io"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.b": ("a.b", "b"), "a.com.": ("com.", ""), "..": (".", ""),
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in rows.select("host", R.domain_of(rows.host).alias("d"), R.suffix_of(rows.host).alias("s")).collect()}
    assert got == hosts
    # strangers under one suffix of two labels do not vouch for each other, unless the policy says so
    outcomes = spark.createDataFrame([("http://bad.co.uk/", 0)] * 50 + [("http://good.co.uk/", 1)] * 50 + [("http://good.com/", 1)] * 50, "url string, good int")
    pages = spark.createDataFrame([(1, "http://www.bad.co.uk/x"), (2, "http://new.co.uk/x")], "page_id long, url string")
    wide, narrow = ({r.page_id: r.bound for r in R.judge_urls(pages, outcomes, policy=R.Policy(suffixes=s)).collect()} for s in (R.SUFFIXES, ()))
    assert wide[1] < wide[2] and narrow[1] == narrow[2]
