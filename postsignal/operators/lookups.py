"""Joins that add context to posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.functions.media import media_key
from postsignal.functions.text import strip, text_or_empty
from postsignal.operators.rows import exploded
from postsignal.runtime import materialize

#: Turn numbers of a conversation that are looked at together.
STRETCH = 4_096
#: Characters of the parts that lexicon terms are found by.
GRAM = 4


def attach_ocr(posts: DataFrame, ocr: DataFrame, post_id: str = "post_id") -> DataFrame:
    """Fill empty ``ocr_text`` of media items from a table (media_id, ocr_text).

    Items are exploded, joined and put back in order; a post holds few items, so the regrouping
    is bounded by the post. Posts without media skip the join.
    """
    items = exploded(posts, F.col("media"), "_m", post_id, position="_i").withColumn(
        "media_id", media_key(F.col("_m.id"), F.col("_m.source_url"), F.col("_i"))
    )
    found = items.join(ocr.select("media_id", F.col("ocr_text").alias("_ocr")), "media_id", "left")
    own = strip(text_or_empty(F.col("_m.ocr_text")))
    text = F.when(own != "", own).otherwise(strip(text_or_empty(F.col("_ocr"))))
    regrouped = (
        found.select(post_id, "_i", F.col("_m").withField("ocr_text", text).alias("_m"))
        .groupBy(post_id)
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_items"))
        .select(post_id, F.col("_items")["_m"].alias("_media"))
    )
    joined = posts.join(regrouped, post_id, "left")
    return joined.withColumn("media", F.coalesce("_media", "media")).drop("_media")


def with_previous_text(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text",
    out: str = "quoted_text",
) -> DataFrame:
    """Text of the turn before, as the quoted context of each turn; '' for the first.

    A conversation is cut into stretches of ``STRETCH`` turn numbers, so that an endless one does
    not end up in one task. Inside a stretch the text before is a neighbour; only the first turn
    of a stretch takes the last text of the stretch before it, one row per stretch.
    """
    cut = turns.withColumn("_s", F.floor(F.col(turn) / STRETCH))
    inside = Window.partitionBy(conversation, "_s").orderBy(turn)
    near = cut.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_near", F.lag(F.coalesce(text, F.lit(""))).over(inside))
    ends = cut.groupBy(conversation, "_s").agg(F.max_by(F.coalesce(text, F.lit("")), turn).alias("_end"))
    across = Window.partitionBy(conversation).orderBy("_s")
    ends = ends.select(conversation, "_s", F.lag("_end").over(across).alias("_far"))
    joined = near.join(ends, [conversation, "_s"], "left")
    before = F.when(F.col("_first"), F.col("_far")).otherwise(F.col("_near"))
    return joined.withColumn(out, F.coalesce(before, F.lit(""))).drop("_s", "_first", "_near", "_far")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


def tag_with_terms(posts: DataFrame, lexicon: DataFrame, ids: Sequence[str], text: str = "text") -> DataFrame:
    """Tags of a lexicon *table* (category, term): one row per distinct ids and category with a hit.

    Both sides are tables of any size. A term is anchored by the one of its ``GRAM``-character parts
    that fewest posts hold (a shorter term by itself). Posts send the distinct parts of their texts
    that occur in some term, join the anchors, and only the terms found this way are looked for in
    their texts with ``contains``.
    """
    key = F.struct(*ids)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    terms = lexicon.select("category", F.lower("term").alias("term")).filter("term <> ''").distinct()
    terms = materialize(terms.withColumn("_n", F.least(F.length("term"), F.lit(GRAM))))
    lengths = sorted(r["_n"] for r in terms.select("_n").distinct().collect())  # at most GRAM numbers
    if not lengths:
        return posts.select(*ids, F.lit("").alias("category")).limit(0)

    def grams(value: Column, n: int) -> Column:
        # a look-ahead matches at every position; cutting by position would read the text anew each time
        return F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))

    of_term = F.lit(None).cast("array<string>")
    for n in lengths:
        of_term = F.when(F.col("_n") == n, grams(F.col("term"), n)).otherwise(of_term)
    wanted = materialize(terms.select("term", F.explode(of_term).alias("_gram")).distinct())
    lowered = posts.select(key.alias("_id"), low.alias("_low"))
    parts = F.concat(*[grams(F.col("_low"), n) for n in lengths])
    held = exploded(lowered, parts, "_gram", "_id").join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    held = materialize(held)
    counts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"))
    anchors = wanted.join(counts, "_gram").groupBy("term").agg(F.min_by("_gram", F.struct("_c", "_gram")).alias("_gram"))
    keyed = materialize(terms.join(anchors, "term").select("_gram", "category", "term"))
    # as many entries as a post has candidate terms
    found = held.join(keyed, "_gram").groupBy("_id").agg(F.collect_set(F.struct("category", "term")).alias("_terms"))
    checked = lowered.join(found, "_id").select("_id", F.filter("_terms", lambda t: F.contains("_low", t["term"])).alias("_hits"))
    return checked.select(F.explode(F.array_distinct(F.col("_hits.category"))).alias("category"), "_id").distinct().select("_id.*", "category")
