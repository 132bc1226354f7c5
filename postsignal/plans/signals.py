"""Posts to events, risks, scores and decisions.

Every step is a narrow projection over built-in expressions. Steps are staged as named columns:
an expression read by several later ones (lower-cased text, issues, scores) is evaluated once
per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions import media as M
from postsignal.functions import scores as C
from postsignal.functions import text as X
from postsignal.policies import SignalDefaults


@dataclass(frozen=True)
class SignalLexicon:
    event_rules: Sequence[tuple[str, Sequence[str]]] = field(default_factory=lambda: lx.EVENT_RULES)
    risk: Mapping[str, Sequence[str]] = field(default_factory=lambda: lx.RISK_WORDS)
    quote_risk: Sequence[str] = field(default_factory=lambda: lx.QUOTE_RISK_WORDS)
    claims: Sequence[str] = field(default_factory=lambda: lx.CLAIM_WORDS)


def with_events(posts: DataFrame, lexicon: SignalLexicon = SignalLexicon()) -> DataFrame:
    """Event type, title and summary from text, quote and alternative texts."""
    context = X.combined_context(F.col("text"), F.col("quoted_text"), F.col("media")["alt_text"])
    staged = posts.withColumn("context", context).withColumn("_low", F.lower("context"))
    return staged.select(
        *[c for c in staged.columns if c != "_low"],
        X.event_type_of(F.col("_low"), lexicon.event_rules).alias("event_type"),
        F.substring("context", 1, 80).alias("title"),
        F.substring("context", 1, 240).alias("summary"),
        F.lit(1).cast("long").alias("source_count"),
    )



def with_risk(events: DataFrame, lexicon: SignalLexicon = SignalLexicon()) -> DataFrame:
    """Media context, media/quote risk and the risk score with its issues."""
    staged = (
        events.withColumn("_low", F.lower("summary"))
        .withColumn("media_context", M.media_context_score(F.col("media")))
        .withColumn("media_risk", M.max_media_risk(F.col("media")))
        .withColumn("quote_risk", X.quote_context_risk(F.col("quoted_text"), lexicon.quote_risk))
        .withColumn("risk_issues", C.risk_issues(F.col("_low"), lexicon.risk))
        .withColumn("has_claim", X.contains_any(F.col("_low"), lexicon.claims))
    )
    risk = C.risk_score(F.col("risk_issues"), F.col("media_risk"), F.col("quote_risk"))
    return staged.withColumn("risk_score", risk).drop("_low")


def _input(df: DataFrame, name: str, default: float) -> Column:
    """Column of that name where the caller supplies one, else the default."""
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def with_scores(risked: DataFrame, defaults: SignalDefaults = SignalDefaults()) -> DataFrame:
    """Event score, decision and account score.

    ``source_reliability``, ``source_count_score``, ``velocity_score``, ``novelty_score`` and
    ``fatigue_score`` are taken from the input where present.
    """
    relevant = F.col("event_type") != "other"
    event = C.event_score(
        source_reliability=_input(risked, "source_reliability", defaults.source_reliability),
        source_count_score=_input(risked, "source_count_score", defaults.source_count_score),
        velocity_score=_input(risked, "velocity_score", defaults.velocity_score),
        relevance_score=F.when(relevant, defaults.relevant_score).otherwise(defaults.irrelevant_score),
        novelty_score=_input(risked, "novelty_score", defaults.novelty_score),
        media_context_score=F.col("media_context"),
        risk_score=F.col("risk_score"),
        fatigue_score=_input(risked, "fatigue_score", defaults.fatigue_score),
    )
    account = C.account_score(
        football_relevance=F.when(relevant, defaults.relevant_account).otherwise(defaults.irrelevant_account),
        early_signal_quality=F.lit(defaults.early_signal),
        media_context_quality=F.col("media_context"),
        quote_context_quality=F.when(X.text_or_empty(F.col("quoted_text")) != "", defaults.quote_present).otherwise(0.0),
        language_style_fit=F.lit(defaults.language_fit),
        engagement_quality=F.lit(defaults.engagement),
        misinformation_risk=F.when(F.col("has_claim"), defaults.claim_risk).otherwise(0.0),
        toxicity_risk=F.lit(defaults.toxicity),
    )
    return (
        risked.withColumn("event_score", event)
        .withColumn("candidate_score", account)
        .withColumn("decision", C.decision_label(F.col("event_score"), F.col("risk_score")))
    )


def post_signals(
    posts: DataFrame, lexicon: SignalLexicon = SignalLexicon(), defaults: SignalDefaults = SignalDefaults()
) -> DataFrame:
    """Posts (text, quoted_text, media, author_handle, ordinal) with all their signals."""
    return with_scores(with_risk(with_events(posts, lexicon), lexicon), defaults)


def decision_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("decision", "event_type").agg(F.count(F.lit(1)).alias("posts"))
