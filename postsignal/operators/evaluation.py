"""How good rankings and probabilities are, per segment.

Ties are decided by the item, so figures do not depend on the order of rows. Everything is a sum per group
combined on the map side; only the first ``k`` rows of a query are ever ranked, and the place of the first
relevant item is a count, so a query with a third of all rows is no large window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import written


def ranking_metrics(judged: DataFrame, query: str, item: str, score: str, gain: str, k: int = 10) -> DataFrame:
    """(query, items, relevant, ndcg, precision, recall, reciprocal_rank) of each query's ranking by falling score.

    Equal scores rank by rising item. An item with a gain above zero is relevant; null gains are zero, null
    scores rank last. NDCG uses gain / log2(place + 1) of the first ``k`` against the best order. Queries
    without a relevant item have ndcg, recall and reciprocal rank null.
    """
    rows = written(
        judged.select(
            F.col(query).alias("query"), F.col(item).alias("item"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("score"),
            F.greatest(F.coalesce(F.col(gain).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("gain"),
        ),
        "judged",
    )
    own = Window.partitionBy("query")
    discounted = F.col("gain") / F.log2(F.col("place") + 1)

    def first(*order: Column) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(own.orderBy(*order))).filter(F.col("place") <= k)

    got = first(F.desc("score"), F.asc("item")).groupBy("query").agg(F.sum(discounted).alias("dcg"), F.count_if(F.col("gain") > 0).alias("hits"), F.count(F.lit(1)).alias("shown"))
    best = first(F.desc("gain"), F.asc("item")).groupBy("query").agg(F.sum(discounted).alias("ideal"))
    totals = rows.groupBy("query").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("gain") > 0).alias("relevant"))
    # the best placed relevant item of a query, and how many come before it
    top = rows.filter("gain > 0").groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("item").alias("at"))).alias("top"))
    before = (-F.col("score") < F.col("top.minus")) | ((-F.col("score") == F.col("top.minus")) & (F.col("item") < F.col("top.at")))
    places = rows.join(written(top, "first-relevant"), "query").groupBy("query").agg((F.count_if(before) + 1).alias("place"))
    joined = totals.join(got, "query").join(best, "query").join(places, "query", "left")
    some = F.col("relevant") > 0
    return joined.select(
        F.col("query").alias(query), "items", "relevant", F.when(some, F.col("dcg") / F.col("ideal")).alias("ndcg"), (F.col("hits") / F.lit(k)).alias("precision"),
        F.when(some, F.col("hits") / F.col("relevant")).alias("recall"), (1 / F.col("place")).alias("reciprocal_rank"),
    )


def reliability(rows: DataFrame, segments: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """(segments, bin, n, mean_probability, mean_outcome, squared, log_loss): sums of a reliability diagram.

    Bins are of equal width, each with its lower edge; a probability of one is in the last. Rows with a null or
    a probability outside [0, 1] are left out. ``squared`` and ``log_loss`` are sums, so bins can be added up.
    """
    p, y = F.col(probability).cast("double"), F.col(outcome).cast("double")
    kept = rows.filter(p.between(0.0, 1.0) & y.isNotNull())
    near = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return kept.groupBy(*segments, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("mean_outcome"), F.sum((p - y) * (p - y)).alias("squared"),
        F.sum(-y * F.ln(near) - (1 - y) * F.ln(1 - near)).alias("log_loss"),
    )


def calibration(rows: DataFrame, segments: Sequence[str], probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """(segments, n, brier, log_loss, ece, mce): Brier score, mean log loss, expected and greatest calibration error."""
    cells = reliability(rows, segments, probability, outcome, bins)
    gap = F.abs(F.col("mean_probability") - F.col("mean_outcome"))
    return cells.groupBy(*segments).agg(
        F.sum("n").alias("total"), (F.sum("squared") / F.sum("n")).alias("brier"), (F.sum("log_loss") / F.sum("n")).alias("log_loss"),
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
    ).withColumnRenamed("total", "n")
