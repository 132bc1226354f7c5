"""Diverse top lists for all queries at once, by maximal marginal relevance.

In each of ``k`` rounds every query takes the item with the best balance of relevance and distance from what
it has taken: one maximum per query, combined on the map side, then one join that tells the query's items
how near the new one is. A query's items are never in one task, so it may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.runtime import written


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; zero if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def marginal_relevance(items: DataFrame, k: int, balance: float = 0.7, digits: int = 9) -> DataFrame:
    """(query, item, place, score): the ``k`` items that each query takes, in order.

    ``items`` is (query, item, relevance, vector), one row per query and item, vectors of doubles without nulls.
    The score is ``balance * relevance - (1 - balance) * nearest``, where nearest is the greatest cosine with an
    item taken before (zero at first), rounded to ``digits``; ties go to the smaller item. Rows with a null are left out.
    """
    left = written(items.select("query", "item", F.col("relevance").cast("double").alias("relevance"), "vector", F.lit(None).cast("double").alias("nearest")).dropna(subset=["query", "item", "relevance", "vector"]), "candidates")
    taken = []
    for place in range(1, k + 1):
        score = F.round(balance * F.col("relevance") - (1 - balance) * F.coalesce("nearest", F.lit(0.0)), digits)
        best = left.groupBy("query").agg(F.min(F.struct((-score).alias("minus"), F.col("item").alias("item"), F.col("vector").alias("vector"))).alias("b"))
        best = written(best.select("query", F.col("b.item").alias("won"), (-F.col("b.minus")).alias("score"), F.col("b.vector").alias("last")), "round")
        taken.append(best.select("query", F.col("won").alias("item"), F.lit(place).cast("long").alias("place"), "score"))
        if place < k:
            rest = left.join(best.select("query", "won", "last"), "query").filter("item <> won")
            left = written(rest.select("query", "item", "relevance", "vector", F.greatest("nearest", cosine(F.col("vector"), F.col("last"))).alias("nearest")), "candidates")
    whole = taken[0]
    for part in taken[1:]:
        whole = whole.unionByName(part)
    return whole


def with_centroid_relevance(items: DataFrame, query: str, item: str, vector: str) -> DataFrame:
    """(query, item, relevance, vector): how near each item of a group lies to the group's mean vector.

    Vectors that are null or hold null or non-finite entries are left out. Sums run over (group, dimension).
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = items.select(F.col(query).alias("query"), F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("vector")).filter(F.coalesce(fine, F.lit(False)))
    means = rows.select("query", F.posexplode("vector").alias("i", "x")).groupBy("query", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return rows.join(written(means, "means"), "query").select("query", "item", cosine(F.col("vector"), F.col("mean")).alias("relevance"), "vector")
