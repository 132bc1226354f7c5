"""Repetition of recent texts by the same author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.operators.rows import exploded
from postsignal.runtime import written

#: Characters that separate words.
GAPS = r"[^\p{L}\p{N}_]+"

#: Different texts of an author and stretch up to which they are compared whole with every text that may repeat them.
FEW_SETS = 64


def shingles(text: Column) -> Column:
    """Distinct pairs of neighbouring words of a lower-cased text; a single word stands alone."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(words))


def _score(similarity: Column, threshold: float) -> Column:
    return F.when(similarity >= threshold, 80.0).otherwise(
        F.greatest(F.lit(0.0), (similarity - 0.5) * 100)
    )


def _prefixes(sets: DataFrame, floor: float) -> DataFrame:
    """(set, shingle): the rarest shingles of each set, enough that sets of Dice similarity ``floor`` share one.

    ``sets`` is (set, shingles, n). Such a pair shares at least ``floor / (2 - floor)`` of either set, so two
    sets without a common shingle among the first ``n - that + 1`` of one order for all cannot be a pair. In
    the order of rarity, what very many texts hold comes last and is left out, unless it makes up more than
    that share of a text: such texts are candidates for each other.
    """
    rows = written(exploded(sets.select("set", "n", "shingles"), F.col("shingles"), "shingle", "set", "n"), "shingles")
    rarity = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")), "shingle-counts")
    ranked = rows.join(rarity, "shingle").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("_r"))
    length = (F.col("n") - F.ceil(F.col("n") * (floor / (2 - floor)) - 1e-9) + 1).cast("int")
    return exploded(ranked, F.slice("_r", 1, length)["shingle"], "shingle", "set")


def _dice() -> Column:
    return 2.0 * F.size(F.array_intersect("_a", "_b")) / (F.col("_n") + F.col("_m"))


def _near_few(texts: DataFrame, others: DataFrame, floor: float) -> DataFrame:
    """(author, _k, mine, other, similarity) from ``floor`` up, ``other`` one of the few sets of its stretch.

    Every set of the author meets those of its own stretch and the one before, at most ``FEW_SETS`` in each, as it
    is: there is no index and no row for a shingle. Sets of too unequal size are left out unread.
    """
    stretches = F.explode(F.array(F.col("_k"), F.col("_k") - 1)).alias("_k")
    mine = texts.select("author", stretches, F.col("set").alias("mine"), F.col("n").alias("_n"), F.col("shingles").alias("_a"))
    other = others.select("author", "_k", F.col("set").alias("other"), F.col("n").alias("_m"), F.col("shingles").alias("_b"))
    likely = (F.col("mine") != F.col("other")) & (2.0 * F.least("_n", "_m") / (F.col("_n") + F.col("_m")) >= floor)
    pairs = mine.join(other, ["author", "_k"]).filter(likely)
    return pairs.select("author", "_k", "mine", "other", _dice().alias("similarity")).filter(F.col("similarity") >= floor)


def _near_many(texts: DataFrame, fresh: DataFrame, others: DataFrame, floor: float) -> DataFrame:
    """(author, _k, mine, other, similarity) from ``floor`` up, ``other`` one of the many sets of its stretch.

    Different sets meet where they share a shingle of their prefixes, and are compared whole.
    """
    old = written(others.select("author", "_k", "set"), "old")
    new = written(fresh.select("author", "_k", "set").distinct().join(old.select("author", "_k").distinct(), ["author", "_k"]), "new")
    needed = old.select("set").union(new.select("set")).distinct()
    sets = written(texts.join(needed, "set", "left_semi").groupBy("set").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n")), "sets")
    prefixes = written(_prefixes(sets, floor), "prefixes")
    new = new.join(prefixes, "set").select("author", "_k", "shingle", F.col("set").alias("mine"))
    old = old.join(prefixes, "set").select("author", "_k", "shingle", F.col("set").alias("other"))
    met = written(new.join(written(old, "old-prefixes"), ["author", "_k", "shingle"]).filter("mine <> other").select("author", "_k", "mine", "other").distinct(), "met")
    side = lambda name, size, values: sets.select(F.col("set").alias(name), F.col("n").alias(size), F.col("shingles").alias(values))
    whole = met.select("mine", "other").distinct().join(side("mine", "_n", "_a"), "mine").join(side("other", "_m", "_b"), "other")
    near = written(whole.select("mine", "other", _dice().alias("similarity")).filter(F.col("similarity") >= floor), "near-sets")
    return met.join(near, ["mine", "other"]).select("author", "_k", "mine", "other", "similarity")


def recent_similarity(posts: DataFrame, item: str, author: str, at: str, text: str, window: int, floor: float = 0.5) -> DataFrame:
    """(item, similarity): greatest overlap with an earlier text of the author inside the window, from ``floor`` up.

    The measure is the Dice coefficient of the shingles, ``2 * shared / (a + b)``. Time is cut into
    stretches of the window's length, so a post shares a stretch with every text it may repeat:
    its own or the one before. Equal sets of one author and stretch are one, with their first and last time,
    so a text posted a million times is one row; a post whose set has come before has similarity 1 and meets
    no other. A stretch of ``FEW_SETS`` different sets or fewer is met by whole sets, one of more by an index of
    shingles: the result is the same.
    """
    narrow = posts.select(F.col(item).alias("item"), F.col(author).alias("author"), F.col(at).alias("at"), shingles(F.col(text)).alias("_s"))
    hashed = narrow.filter("author is not null and at is not null").withColumn("shingles", F.array_sort(F.transform("_s", lambda s: F.xxhash64(s))))
    timed = written(hashed.filter(F.size("shingles") > 0).select("item", "author", "at", F.floor(F.col("at") / window).alias("_k"), F.sha2(F.to_json("shingles"), 256).alias("set"), F.size("shingles").alias("n"), "shingles"), "timed")
    spans = timed.groupBy("author", "_k", "set").agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    texts = written(spans, "texts")
    seen = texts.select("author", "_k", "set", "_first", "_last")
    posts_of = timed.select("item", "author", "at", "set", F.explode(F.array(F.col("_k"), F.col("_k") - 1)).alias("_k"))
    # the first time in a post's own stretch, the last in the one before
    recent = ((F.col("_first") < F.col("at")) & (F.col("_first") >= F.col("at") - window)) | ((F.col("_last") < F.col("at")) & (F.col("_last") >= F.col("at") - window))
    repeated = written(posts_of.join(seen, ["author", "_k", "set"]).filter(recent).select("item").distinct(), "repeated")
    fresh = written(posts_of.join(repeated, "item", "left_anti"), "fresh")
    many = written(texts.groupBy("author", "_k").agg(F.count(F.lit(1)).alias("_sets")).filter(F.col("_sets") > FEW_SETS).select("author", "_k"), "many")
    if many.isEmpty():
        near = _near_few(texts, texts, floor)
    else:
        near = _near_few(texts, texts.join(many, ["author", "_k"], "left_anti"), floor)
        near = near.union(_near_many(texts, fresh, texts.join(many, ["author", "_k"], "left_semi"), floor))
    linked = written(near, "near").join(seen.withColumnRenamed("set", "other"), ["author", "_k", "other"])
    found = fresh.withColumnRenamed("set", "mine").join(linked, ["author", "_k", "mine"]).filter(recent).select("item", "similarity")
    return found.union(repeated.select("item", F.lit(1.0).alias("similarity"))).groupBy("item").agg(F.max("similarity").alias("similarity"))


def fatigue(
    posts: DataFrame, window: int, item: str = "post_id", author: str = "author_handle", at: str = "ordinal",
    text: str = "text", threshold: float = 0.85,
) -> DataFrame:
    """Fatigue score of every post from its most similar text by the same author.

    Compared are the texts whose time ``at`` lies before the post's own, by at most ``window``: the
    caller says what counts as recent. 80 with an issue at or above the threshold; else
    100 * (similarity - 0.5), at least 0; 0 without earlier texts.
    """
    best = recent_similarity(posts, item, author, at, text, window).withColumnRenamed("item", item)
    similarity = F.coalesce(F.col("similarity"), F.lit(0.0))
    return posts.select(item).join(best, item, "left").select(
        item,
        _score(similarity, threshold).alias("fatigue_score"),
        F.when(similarity >= threshold, "near_duplicate_text").otherwise("").alias("issue"),
    )
