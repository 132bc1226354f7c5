"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages are good or bad. A host with few of them says little, so its rate is shrunk towards
that of its registered domain, that towards its suffix, and that towards the whole table: at each
level the parent's rate is the mean of a beta prior whose strength is fitted to how much the children
of the level really differ (method of moments on the beta-binomial). A host that was never labelled
has its nearest labelled ancestor's posterior. A page passes when the lower bound of its host's
posterior (mean less ``z`` standard deviations) reaches a limit.

Counts are summed per host before anything is shuffled by a larger group, so a host with a third of
all pages sends one row per task. Pages meet the posteriors by an equi-join on the host; posteriors
are a written table, so adaptive execution splits hot hosts. Rules are a literal list, a policy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import stored


#: Common public suffixes of two labels, and some hosts of users' own pages.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "ac.jp",
    "co.kr", "or.kr", "com.br", "org.br", "com.cn", "org.cn", "com.tw", "com.hk", "com.sg", "com.mx", "com.ar", "com.co", "com.tr", "org.tr", "com.ua", "co.il",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "herokuapp.com",
)


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Policy:
    """Prior strength limits, and the bound that a host must reach.

    ``strength`` are the least and greatest pseudo-counts of a prior; ``first`` is the beta prior of
    the whole table, one good and one bad page. ``suffixes`` are those of several labels under which
    strangers register names; any other suffix is the last label of a host.
    """

    limit: float = 0.7
    z: float = 1.0
    strength: tuple[float, float] = (1.0, 1000.0)
    first: tuple[float, float] = (1.0, 1.0)
    suffixes: tuple[str, ...] = SUFFIXES


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path; both empty without it."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def suffix_pattern(suffixes: Sequence[str]) -> str:
    """What may follow a registered name: one of ``suffixes``, the longest that fits, or else the last label."""
    listed = "|".join(s.lower().replace(".", r"\.") for s in suffixes)
    return f"(?:{listed}|[^.]*)" if listed else "[^.]*"


def domain_pattern(suffixes: Sequence[str]) -> str:
    return rf"(?:^|\.)([^.]*\.{suffix_pattern(suffixes)}|[^.]*)$"


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Registered domain: the suffix and the label before it, or the host if it has no more."""
    return F.regexp_extract(host, domain_pattern(suffixes), 1)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that ends the host at a label's border, or else the last label."""
    return F.regexp_extract(host, rf"(?:^|\.)({suffix_pattern(suffixes)})$", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r.text), r.text))
    for rule in ordered:
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _strength(counts: DataFrame, policy: Policy) -> float:
    """Pseudo-counts of the prior that a level's children share; one number of the whole level.

    ``counts`` has good and n of each child and ``rate``, its parent's. The variance beyond the
    binomial one gives rho = (sum (good - n p)^2 - n p (1 - p)) / (sum n (n - 1) p (1 - p)), and the
    strength is 1 / rho - 1, kept within the policy's limits.
    """
    n, good, p = F.col("n"), F.col("good"), F.col("rate")
    sums = counts.agg(
        F.sum((good - n * p) * (good - n * p) - n * p * (1 - p)).alias("beyond"),
        F.sum(n * (n - 1) * p * (1 - p)).alias("pairs"),
    ).first()
    low, high = policy.strength
    rho = sums["beyond"] / sums["pairs"] if sums["pairs"] else 0.0
    return min(max(1 / rho - 1, low), high) if rho > 0 else high


def _posteriors(counts: DataFrame, key: str, policy: Policy) -> DataFrame:
    """(key, alpha, beta, rate) of each child from its counts and its parent's rate."""
    counts = stored(counts, f"{key}-counts")
    strength = _strength(counts, policy)
    alpha = F.col("rate") * strength + F.col("good")
    beta = (1 - F.col("rate")) * strength + F.col("n") - F.col("good")
    return stored(counts.select(key, alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("rate")), f"{key}-reputation")


def reputations(outcomes: DataFrame, policy: Policy = Policy()) -> tuple[dict[str, DataFrame], tuple[float, float]]:
    """Posteriors (key, alpha, beta, rate) of hosts, domains and suffixes, and (alpha, beta) of all.

    ``outcomes`` has host and good (0 or 1); rows with a null in either are no outcome.
    """
    hosts = stored(
        outcomes.filter("host is not null and good is not null").groupBy("host").agg(
            F.sum(F.col("good").cast("double")).alias("good"), F.count(F.lit(1)).cast("double").alias("n")
        ).withColumn("domain", domain_of(F.col("host"), policy.suffixes)).withColumn("suffix", suffix_of(F.col("host"), policy.suffixes)),
        "host-outcomes",
    )
    total = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    alpha, beta = policy.first[0] + total["good"], policy.first[1] + total["n"] - total["good"]
    sums = (F.sum("good").alias("good"), F.sum("n").alias("n"))
    levels = {}
    levels["suffix"] = _posteriors(hosts.groupBy("suffix").agg(*sums).withColumn("rate", F.lit(alpha / (alpha + beta))), "suffix", policy)
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(levels["suffix"].select("suffix", "rate"), "suffix")
    levels["domain"] = _posteriors(domains, "domain", policy)
    levels["host"] = _posteriors(hosts.join(levels["domain"].select("domain", "rate"), "domain"), "host", policy)
    return levels, (alpha, beta)


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Mean of a beta distribution less ``z`` standard deviations."""
    total = alpha + beta
    return alpha / total - F.lit(float(z)) * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), policy: Policy = Policy(), page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, bound.

    ``outcomes`` has url and good (0 or 1) of labelled pages. The longest rule that fits decides, else
    the posterior bound of the host; of a host without outcomes, of its domain, suffix or the table.
    Null urls and urls without ``://`` have an empty host and path and are judged like any other host.
    Repeated rows are judged one by one; other columns are ignored; an empty table gives an empty
    result, and no outcomes at all leave the prior of the policy.
    """
    label_host, _ = host_and_path(F.col("url"))
    levels, (alpha, beta) = reputations(outcomes.select(label_host.alias("host"), "good"), policy)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # posteriors are joined per distinct host, pages once
    hosts = rows.select("host").distinct().withColumn("domain", domain_of(F.col("host"), policy.suffixes)).withColumn("suffix", suffix_of(F.col("host"), policy.suffixes))
    for key in ("host", "domain", "suffix"):
        bound = lower_bound(F.col("alpha"), F.col("beta"), policy.z)
        hosts = hosts.join(levels[key].select(key, bound.alias(f"_{key}")), key, "left")
    of_all = lower_bound(F.lit(alpha), F.lit(beta), policy.z)
    known = stored(hosts.select("host", F.coalesce("_host", "_domain", "_suffix", of_all).alias("bound")), "host-bounds")
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    decided = F.when(F.col("bound") >= policy.limit, "allow").otherwise("block")
    return rows.join(known, "host").select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, decided).alias("verdict"), "bound"
    )
