"""Summary reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal import lexicons as lx


def weekly_report(feedback: DataFrame, weights: DataFrame) -> DataFrame:
    """Feedback counts per action and the current weights as one report text.

    Counts are aggregated before they are listed: the lists have one entry per action and per
    weight key.
    """
    counts = feedback.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    actions = counts.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("action", "n"))),
                lambda r: F.concat(r["action"], F.lit(": "), r["n"].cast("string")),
            ),
            ", ",
        ).alias("a")
    )
    listed = weights.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("key", "value"))),
                lambda r: F.concat(r["key"], F.lit("="), F.format_string("%.2f", r["value"])),
            ),
            "; ",
        ).alias("w")
    )
    text = F.concat(
        F.lit("Weekly learning report\nFeedback: "),
        F.coalesce(F.nullif(F.col("a"), F.lit("")), F.lit("no feedback yet")),
        F.lit("\nWeights: "),
        F.coalesce(F.nullif(F.col("w"), F.lit("")), F.lit("default weights")),
        F.lit("\n" + lx.REPORT_NEXT_ACTION),
    )
    return actions.withColumn("w", listed.scalar()).select(text.alias("report"))


def capture_quality(validated: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Captures per source and outcome with subtotals: accepted or the reason of rejection.

    A capture breaking several rules counts once per rule. With ``kept`` (post_id of the captures
    left after deduplication) accepted captures that were dropped count as ``duplicate``.
    """
    outcome = F.when(F.size("errors") == 0, F.array(F.lit("accepted"))).otherwise(F.col("errors"))
    rows = validated.withColumn("_o", outcome)
    if kept is not None:
        rows = rows.join(kept.select("post_id", F.lit(True).alias("_kept")), "post_id", "left").withColumn(
            "_o",
            F.when((F.size("errors") == 0) & F.col("_kept").isNull(), F.array(F.lit("duplicate"))).otherwise(F.col("_o")),
        )
    flat = rows.select("author_handle", F.explode("_o").alias("outcome"))
    counted = flat.rollup("outcome", "author_handle").agg(F.count(F.lit(1)).alias("captures"), F.grouping_id().alias("level"))
    return counted.select(
        F.coalesce("outcome", F.lit("(all)")).alias("outcome"),
        F.coalesce("author_handle", F.lit("(all)")).alias("author_handle"),
        "captures",
        F.col("level").cast("int").alias("level"),
    )


def parse_quality_summary(captures: DataFrame) -> DataFrame:
    """How complete parsed captures are, per selector version."""
    q = F.col("parse_quality")
    return captures.groupBy(q["selector_version"].alias("selector_version")).agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if(q["has_url"]).alias("with_url"),
        F.count_if(q["has_author"]).alias("with_author"),
        F.count_if(q["has_text"]).alias("with_text"),
        F.count_if(q["has_quote"]).alias("with_quote"),
        F.sum(q["media_count"]).alias("media_items"),
    )


def analysed_posts(posts: DataFrame, categories=None, positive=None, negative=None) -> DataFrame:
    """Cleaned text (with alternative texts), categories, sentiment and media descriptions."""
    from postsignal.functions.media import describe_media
    from postsignal.functions.text import classify_text, collapse_text, estimate_sentiment, strip, text_or_empty

    image_alt = F.nullif(F.col("image_alt"), F.lit("")) if "image_alt" in posts.columns else F.lit(None).cast("string")
    combined = F.concat_ws(
        " ", text_or_empty(F.col("text")), image_alt, F.array_remove(F.col("media")["alt_text"], "")
    )
    staged = posts.withColumn("cleaned_text", collapse_text(strip(combined)))
    return staged.select(
        "post_id",
        "cleaned_text",
        classify_text(F.col("cleaned_text"), categories).alias("categories"),
        estimate_sentiment(
            F.col("cleaned_text"),
            tuple(positive if positive is not None else lx.POSITIVE_WORDS),
            tuple(negative if negative is not None else lx.NEGATIVE_WORDS),
        ).alias("sentiment"),
        describe_media(F.col("media")).alias("media"),
    )
