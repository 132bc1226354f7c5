"""Posts and page facts from HTML, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.operators.capture import redact_url
from postsignal.operators.rows import keep_where

#: Entities that texts may hold, and what they stand for; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, language and number of links."""
    html = F.col("html")
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
        F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).alias("links"),
        F.regexp_count(html, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"),
    )


def visible_text(html: Column) -> Column:
    """Text of a piece of HTML: no tags, entities read, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br[^>]*>", " "), r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Value of a link's address, with its quotes if it has any.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


#: Where a page is cut: before every tag that opens or closes an article.
CUT = r"(?i)(?=<article[\s>]|</article)"


def _opens(piece: Column) -> Column:
    return piece.rlike(r"(?i)^<article[\s>]")


def _step(piece: Column) -> Column:
    return F.when(_opens(piece), 1).when(piece.rlike("(?i)^</article"), -1).otherwise(0)


def _nested(pieces: Column) -> Column:
    """Whether an article opens before the last one is closed."""
    steps = F.filter(F.transform(pieces, _step), lambda s: s != 0)
    rest = F.greatest(F.size(steps) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(steps, 1, rest), F.slice(steps, 2, rest), lambda a, b: (a == 1) & (b == 1)), lambda x: x)


def _nested_articles(cut: DataFrame) -> DataFrame:
    """(page_id, url, position, content) of pages (page_id, url, pieces) with articles inside articles.

    One row per piece with its depth from running sums; a piece belongs to the article that opened last at
    its depth and at each depth above. What moves is each piece once for every article it is in.
    """
    # numbered before the pieces are, so that a number names a page
    rows = cut.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "url", F.posexplode("pieces").alias("at", "piece"))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", _opens(F.col("piece"))).withColumn("sum", F.sum(_step(F.col("piece"))).over(upto))
    # closing tags without an opening one do not count
    rows = rows.withColumn("depth", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto))).cast("int"))
    rows = rows.filter("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    inside = Window.partitionBy("row", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("number", F.sum((F.col("open") & (F.col("level") == F.col("depth"))).cast("int")).over(inside))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    whole = numbered.groupBy("row", "level", "number").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.min("at").alias("begin"), content.alias("content")
    )
    order = Window.partitionBy("row").orderBy("begin")
    return whole.select("page_id", "url", (F.row_number().over(order) - 1).alias("position"), "content")


def articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, content): the articles of each page in the order in which they begin.

    One inside another is in both; an article ends where it is closed, or with the page. A page is cut
    once. Where no article is inside another, each is one of the pieces, and nothing moves.
    """
    openings = F.regexp_count("html", F.lit(r"(?i)<article[\s>]"))
    some = pages.select("page_id", "url", "html", openings.alias("openings"))
    cut = lambda rows: rows.select("page_id", "url", "openings", F.split("html", CUT).alias("pieces"))
    flat = keep_where(cut(some.filter("openings > 0")), (F.col("openings") == 1) | ~_nested(F.col("pieces")))
    plain = flat.select("page_id", "url", F.posexplode(F.filter("pieces", _opens)).alias("position", "content"))
    deep = keep_where(cut(some.filter("openings > 1")), _nested(F.col("pieces")))
    found = plain.unionByName(_nested_articles(deep))
    return found.withColumn("content", F.regexp_replace("content", r"(?is)^<article(?:\s[^>]*)?>?", ""))


def page_posts(pages: DataFrame) -> DataFrame:
    """The articles of each page as posts: (page_id, position, url, heading, text, paragraphs, links).

    ``position`` counts the articles of a page from zero, in the order in which they begin. Tag names may
    be written in any case, and paragraphs need not be closed: one ends where it is closed or where the
    next begins. Addresses of links may be in double, single or no quotes. Pages without an article have
    no post.
    """
    found = articles(pages).withColumnRenamed("content", "_a")
    pieces = F.split("_a", r"(?i)<p(?:\s[^>]*)?>")
    texts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: visible_text(F.regexp_extract(p, r"(?is)^(.*?)(?:</p|$)", 1)))
    staged = found.withColumn("_t", F.filter(texts, lambda t: t != ""))
    return staged.select(
        "page_id",
        F.col("position").cast("long").alias("position"),
        redact_url(F.col("url")).alias("url"),
        visible_text(F.regexp_extract("_a", r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1", 1)).alias("heading"),
        F.array_join("_t", "\n").alias("text"),
        F.size("_t").cast("long").alias("paragraphs"),
        F.transform(F.regexp_extract_all("_a", F.lit(HREF), F.lit(1)), lambda h: F.regexp_replace(h, r"""(?s)^(["'])(.*)\1$""", "$2")).alias("links"),
    )
