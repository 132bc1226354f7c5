"""Account discovery and account roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions.scores import account_action, reach_score, relevance_score
from postsignal.operators.keywords import search_posts, top_tokens


def select_candidates(
    posts: DataFrame, keyword: str, sample_size: int | None = 50, top_n: int = 10,
    lang: str | None = "tr", keyword_count: int = 15,
) -> DataFrame:
    """Authors of posts about a keyword, by mean reach score.

    ``posts`` needs text, lang, author_handle, followers_count, media (array) and quoted_url.
    With ``sample_size=None`` all matching posts count.
    """
    sample = search_posts(posts, keyword, sample_size, lang)
    if not keyword:
        return sample.select("author_handle", F.lit(0.0).alias("score"))
    # One row of at most keyword_count + 1 tokens, read as a scalar subquery.
    tokens = top_tokens(sample, keyword_count).agg(
        F.array_union(F.array(F.lit(keyword.lower())), F.collect_list("token")).alias("keywords")
    )
    scored = sample.withColumn("_keywords", tokens.scalar()).withColumn("_low", F.lower("text"))
    hits = F.size(F.filter("_keywords", lambda k: F.col("_low").contains(k)))
    score = reach_score(
        F.coalesce(F.col("followers_count"), F.lit(0)),
        F.coalesce(F.size("media"), F.lit(0)) > 0,
        F.coalesce(F.col("quoted_url"), F.lit("")) != "",
        hits,
    )
    means = scored.select("author_handle", score.alias("s")).groupBy("author_handle").agg(F.avg("s").alias("score"))
    return means.orderBy(F.desc("score"), "author_handle").limit(max(0, top_n))


def relevant_accounts(
    posts: DataFrame, top_n: int = 10, keywords: Sequence[str] = tuple(lx.ACCOUNT_KEYWORDS)
) -> DataFrame:
    """Authors by mean keyword relevance of their posts."""
    score = relevance_score(F.col("text"), F.col("quoted_text"), F.col("media"), keywords)
    means = posts.select("author_handle", score.alias("s")).groupBy("author_handle").agg(F.avg("s").alias("score"))
    return means.orderBy(F.desc("score"), "author_handle").limit(max(0, top_n))


def account_candidates(signals: DataFrame, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Account verdict from each author's last post."""
    latest = F.max_by(
        F.struct("candidate_score", F.col("text").alias("example_post")),
        F.struct(*[F.col(c) for c in order]),
    )
    return (
        signals.groupBy("author_handle")
        .agg(latest.alias("_last"))
        .select("author_handle", "_last.*")
        .withColumn("action", account_action(F.col("candidate_score")))
    )
