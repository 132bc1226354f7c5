"""Frequent tokens and keyword search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx
from postsignal.functions.text import word_tokens, words
from postsignal.operators.rows import exploded


def token_counts(posts: DataFrame, text: str = "text", min_chars: int = 3) -> DataFrame:
    """Occurrences of every lower-cased white-space token of at least ``min_chars``."""
    tokens = exploded(posts, words(F.lower(F.col(text))), "token")
    return tokens.filter(F.length("token") >= min_chars).groupBy("token").count()


def top_tokens(posts: DataFrame, top_n: int = 10, text: str = "text") -> DataFrame:
    """Most frequent tokens, ties by token."""
    return token_counts(posts, text).orderBy(F.desc("count"), "token").limit(max(0, top_n))


def style_keywords(
    samples: DataFrame, top_k: int = 5, text: str = "text", stopwords: Sequence[str] = tuple(lx.STYLE_STOPWORDS)
) -> DataFrame:
    """Most frequent words of sample texts that are no stop words and longer than two letters."""
    tokens = exploded(samples, word_tokens(F.col(text)), "token")
    kept = tokens.filter((F.length("token") > 2) & ~F.col("token").isin(*stopwords))
    return kept.groupBy("token").count().orderBy(F.desc("count"), "token").limit(max(0, top_k))


def style_suffix(samples: DataFrame, top_k: int = 5, text: str = "text") -> DataFrame:
    """One row holding the style keywords, most frequent first, joined by blanks."""
    ranked = style_keywords(samples, top_k, text)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "token")))
    return ranked.agg(F.array_join(listed["token"], " ").alias("style_suffix"))


def search_posts(
    posts: DataFrame, keyword: str, limit: int | None = 20, lang: str | None = "tr",
    order: Sequence[str] = ("ordinal",),
) -> DataFrame:
    """Newest posts containing the keyword; an empty keyword finds nothing."""
    if not keyword:
        return posts.limit(0)
    found = posts.filter(F.lower("text").contains(keyword.lower()))
    if lang:
        found = found.filter(F.col("lang") == lang)
    if limit is None:
        return found
    return found.orderBy(*[F.desc(c) for c in order]).limit(max(0, limit))


def extended_posts(records: DataFrame) -> DataFrame:
    """Posts from nested search records: author and followers, media addresses, and what is quoted.

    ``records`` has id, url, date, content, user (username, followers_count), media (array with url) and quoted
    (id, content, user, media), the last two possibly null. Media without an address are left out; a record
    without a quote has null quoted_url and quoted_content and no quoted media; a missing follower count is 0.
    """
    quoted = F.col("quoted")
    address = F.concat(F.lit("https://twitter.com/"), quoted["user"]["username"], F.lit("/status/"), quoted["id"].cast("string"))
    urls = lambda media: F.filter(F.coalesce(media["url"], F.array().cast("array<string>")), lambda u: F.coalesce(u != "", F.lit(False)))
    return records.select(
        "id", "url", "date", "content", F.col("user")["username"].alias("user"), F.coalesce(F.col("user")["followers_count"], F.lit(0)).alias("followers_count"),
        urls(F.col("media")).alias("media_urls"), F.when(quoted.isNotNull(), address).alias("quoted_url"), quoted["content"].alias("quoted_content"),
        urls(quoted["media"]).alias("quoted_media_urls"),
    )
