"""Scores and decisions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions.text import contains_any, keyword_hits, text_or_empty, without_nulls
from postsignal.policies import WeightPolicy

# Weights of the two weighted scores.
EVENT_WEIGHTS: dict[str, float] = {
    "source_reliability": 0.25,
    "source_count_score": 0.20,
    "velocity_score": 0.15,
    "relevance_score": 0.15,
    "novelty_score": 0.10,
    "media_context_score": 0.10,
    "risk_score": -0.20,
    "fatigue_score": -0.10,
}
EVENT_DEFAULTS: dict[str, float] = {
    "source_reliability": 50.0,
    "source_count_score": 0.0,
    "velocity_score": 0.0,
    "relevance_score": 50.0,
    "novelty_score": 50.0,
    "media_context_score": 0.0,
    "risk_score": 0.0,
    "fatigue_score": 0.0,
}
ACCOUNT_WEIGHTS: dict[str, float] = {
    "football_relevance": 0.25,
    "early_signal_quality": 0.20,
    "media_context_quality": 0.15,
    "quote_context_quality": 0.15,
    "language_style_fit": 0.10,
    "engagement_quality": 0.10,
    "misinformation_risk": -0.20,
    "toxicity_risk": -0.10,
}


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double")))


def _weighted(weights: Mapping[str, float], defaults: Mapping[str, float], given: Mapping[str, Column]) -> Column:
    unknown = set(given) - set(weights)
    if unknown:
        raise ValueError(f"unknown score inputs: {sorted(unknown)}")
    parts = [
        F.lit(w) * F.coalesce(given[k].cast("double"), F.lit(defaults.get(k, 0.0)))
        if k in given
        else F.lit(w * defaults.get(k, 0.0))
        for k, w in weights.items()
    ]
    return clamp(reduce(lambda a, b: a + b, parts))


def event_score(**inputs: Column) -> Column:
    """Weighted event score 0..100; missing inputs take their defaults."""
    return _weighted(EVENT_WEIGHTS, EVENT_DEFAULTS, inputs)


def account_score(**inputs: Column) -> Column:
    """Weighted account score 0..100; missing inputs count as 0."""
    return _weighted(ACCOUNT_WEIGHTS, {}, inputs)


def account_action(score: Column) -> Column:
    return (
        F.when(score >= 70, "approve_candidate")
        .when(score >= 45, "watch_one_week")
        .otherwise("reject_or_ignore")
    )


def risk_issues(low: Column, lexicon: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Risk categories with a word in the (already lower-cased) text."""
    lexicon = lexicon if lexicon is not None else lx.RISK_WORDS
    return without_nulls(*[F.when(contains_any(low, ws), F.lit(c)) for c, ws in lexicon.items()])


def risk_score(issues: Column, media_risk: Column, quote_risk: Column) -> Column:
    raw = F.lit(18.0) * F.size(issues) + F.lit(0.35) * media_risk + F.lit(0.25) * quote_risk
    return F.least(F.lit(100.0), raw)


def decision_label(event: Column, risk: Column) -> Column:
    return (
        F.when(risk >= 81, "block")
        .when(risk >= 61, "human_review")
        .when(event >= 75, "high_priority_suggestion")
        .when(event >= 60, "normal_suggestion")
        .when(event >= 40, "watch")
        .otherwise("archive")
    )


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Small constant lookup, as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def initial_reliability(source_type: Column) -> Column:
    kind = F.lower(F.coalesce(F.nullif(source_type, F.lit("")), F.lit("unknown")))
    return lookup(kind, lx.SOURCE_RELIABILITY, 30.0)


def updated_reliability(old: Column, observed: Column) -> Column:
    return clamp(old * F.lit(0.85) + observed * F.lit(0.15))


def feedback_reward(action: Column, rewards: Mapping[str, float] | None = None) -> Column:
    return lookup(action, rewards if rewards is not None else lx.FEEDBACK_REWARD, 0.0)


def updated_weight(
    old: Column, reward: Column, feature: Column | None = None, policy: WeightPolicy = WeightPolicy()
) -> Column:
    feature = feature if feature is not None else F.lit(1.0)
    return clamp(old + F.lit(policy.learning_rate) * reward * feature, policy.low, policy.high)


def reach_score(followers: Column, has_media: Column, has_quote: Column, hits: Column) -> Column:
    """Score of one post for account discovery by reach and keyword hits."""
    return (
        F.log10(followers + 1)
        + F.when(has_media, 1.0).otherwise(0.0)
        + F.when(has_quote, 0.5).otherwise(0.0)
        + F.lit(0.3) * hits
    )


def relevance_score(
    text: Column,
    quoted_text: Column,
    media: Column,
    keywords: Sequence[str] = tuple(lx.ACCOUNT_KEYWORDS),
) -> Column:
    """Keyword hits in text, half weight in the quote, double weight per alternative text."""
    alts = F.aggregate(
        F.coalesce(media["alt_text"], F.array().cast("array<string>")),
        F.lit(0.0),
        lambda acc, alt: acc + F.lit(2.0) * keyword_hits(alt, keywords),
    )
    return keyword_hits(text_or_empty(text), keywords) + F.lit(0.5) * keyword_hits(
        quoted_text, keywords
    ) + alts


def retry_delay_cap(attempt: Column, base: float = 2.0, factor: float = 4.0, limit: float = 300.0) -> Column:
    exponent = F.greatest(F.lit(0), attempt - 1)
    return F.least(F.lit(limit), F.lit(base) * F.pow(F.lit(factor), exponent))
