"""Mixing sources to target weights with hash-threshold histograms.

A source whose target is ``p`` full passes plus a rest takes every document ``p`` times, and once more
those whose hash lies below a threshold. The threshold comes from histograms: tokens are summed by
source and leading hash bits, the bucket in which the running sum crosses the rest is found, and only
the documents of that boundary bucket are summed again by their next bits, until a bucket is one hash
value. The documents are never sorted. Thresholds are nested: a smaller target takes a subset of what
a larger one takes, and equal inputs give equal mixes.

Histograms have at most 2^BITS rows per source and are combined on the map side, so a source with a
third of all rows is summed in parallel like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.llm.common import stored, word_count

#: Hash bits that a histogram resolves at a time, and the bits of a hash.
BITS, HASH_BITS = 10, 60


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add the target of each source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` times the
    sum of all sizes. No target exceeds ``most`` times its source's size; what is above is shared
    again by weight. Sources are a dimension: this orders one row per source in one task.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # sources that stop first: smallest cap per weight; they are a prefix of this order
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stopped = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level that holds for all that do not stop is the one of the first of them
    last = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return stopped.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(last * F.col("weight")).alias("target")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, below): the hash below which documents are taken once more.

    ``rows`` has source, size and hash (0 <= hash < 2^HASH_BITS), ``goals`` source and rest. The sum
    of the sizes below the threshold comes as near to the rest as whole hash values allow; of two
    equally near ones, the larger.
    """
    low = HASH_BITS
    # start: first hash of the boundary bucket; done: tokens below it
    state = stored(goals.select("source", "rest", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("done")), "mix-state")
    held = rows
    while low:
        low -= BITS
        edge = F.shiftright(F.col("hash"), low)
        sums = held.groupBy("source", edge.alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = state.select(F.col("source").alias("_source"), "rest", "done")
        placed = sums.join(known, F.col("source").eqNullSafe(F.col("_source")))
        reach = placed.withColumn("upto", F.col("done") + F.sum("tokens").over(running))
        # the first bucket that reaches the rest; none if the source ends before
        crossing = reach.filter(F.col("upto") >= F.col("rest")).groupBy("source").agg(
            F.min(F.struct("bucket", "tokens", "upto", "rest")).alias("c")
        )
        state = stored(
            crossing.select(
                "source", F.col("c.rest").alias("rest"), F.shiftleft(F.col("c.bucket"), low).alias("start"),
                (F.col("c.upto") - F.col("c.tokens")).alias("done"), F.col("c.tokens").alias("tokens"),
            ),
            "mix-state",
        )
        if low:
            held = stored(boundary(held, state, low), "mix-boundary")
    # one hash value is left: it is taken if that brings the sum nearer
    take = (F.col("rest") - F.col("done")) * 2 >= F.col("tokens")
    return state.select("source", F.when(take, F.col("start") + 1).otherwise(F.col("start")).alias("below"))


def boundary(held: DataFrame, state: DataFrame, low: int) -> DataFrame:
    """The documents in the boundary bucket of their source."""
    edge = state.select(F.col("source").alias("_source"), F.shiftright("start", low).alias("_edge"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", low) == F.col("_edge"))
    return held.join(edge, same, "left_semi")


def id_hash(doc_id: Column) -> Column:
    """Hash that decides on a document; null ids are one id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def mix_plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, passes, below) from rows with source, size and hash."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, share, most), "mix-targets")
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    planned = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    below = thresholds(rows.filter("size > 0"), planned.filter("rest > 0").select("source", "rest"))
    named = below.withColumnRenamed("source", "_source")
    return stored(
        planned.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")
        ),
        "mix-plan",
    )


WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts the words between ASCII white space (null text: 0); ``taken`` is the number of
    words the mix takes of the document, in whole passes: at most ``ceil(most)`` of them. The hash is
    of the id, so repeated rows are taken alike; null ids are one id. A null source is a source of its
    own, the last. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            id_hash(F.col(doc_id)).alias("hash"),
        ),
        "sized-documents",
    )
    plan = mix_plan(rows, weights, share, most).withColumnRenamed("source", "_source")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * (F.col("passes") + (F.col("hash") < F.col("below")).cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as the mix takes them.

    The texts stay where they are: they meet only the plan, one row per source. Documents without
    words are taken with the passes of their source.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), id_hash(F.col(doc_id)).alias("hash"))
    plan = mix_plan(stored(sized, "sized-documents"), weights, share, most)
    plan = plan.select(F.col("source").alias("_source"), F.col("passes").alias("_passes"), F.col("below").alias("_below"))
    joined = docs.join(plan, F.col(source).eqNullSafe(F.col("_source")))
    times = (F.col("_passes") + (id_hash(F.col(doc_id)) < F.col("_below")).cast("long")).cast("int")
    return joined.withColumn("_pass", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
