"""Stratified reservoir samples as mergeable bottom-k sketches.

Every row draws a priority from a hash of the seed and its id, so a rerun, another partitioning or a lost
executor gives the same sample. The sample of a stratum is its ``k`` smallest priorities, and so the sample
of a union is the sample of the samples. Priorities are exponential with the row's weight as rate: equal
weights give a uniform sample, others one without replacement by weight.

The k smallest are found without sorting the rows: one pass counts the rows of each stratum by the octave of
their priority, combined on the map side; the octave in which a stratum's count passes k bounds the rows
that can be in its sample, on average fewer than 2k of them, and only these are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import written


def uniform(row_id: Column, seed: int = 0) -> Column:
    """A number between 0 and 1, both excluded, that the seed and the id decide: 52 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bottom_k(rows: DataFrame, strata: Sequence[str], k: Column | int, priority: str = "priority", tie: str = "row_id") -> DataFrame:
    """The rows of each stratum with the ``k`` smallest priorities; ties go to the smaller ``tie``.

    ``k`` may be a column of the rows that is constant within a stratum. Rows of equal priority and tie are
    interchangeable.
    """
    size = k if isinstance(k, Column) else F.lit(k)
    octave = F.floor(F.log2(priority)).cast("int")
    marked = rows.withColumn("_k", size.cast("long")).withColumn("_octave", octave)
    key = F.struct(*strata).alias("_stratum")  # null strata are strata like any other
    counts = marked.groupBy(key, "_octave").agg(F.count(F.lit(1)).alias("n"), F.max("_k").alias("_k"))
    upto = Window.partitionBy("_stratum").orderBy("_octave").rowsBetween(Window.unboundedPreceding, -1)  # some sixty octaves
    last = counts.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("below < _k")
    bounds = written(last.groupBy("_stratum").agg(F.max("_octave").alias("_most")), "sample-bounds")
    near = marked.withColumn("_stratum", F.struct(*strata)).join(bounds, "_stratum").filter(F.col("_octave") <= F.col("_most"))
    place = F.row_number().over(Window.partitionBy("_stratum").orderBy(priority, tie))
    return near.withColumn("_place", place).filter(F.col("_place") <= F.col("_k")).drop("_place", "_most", "_octave", "_k", "_stratum")


def stratified_sample(
    rows: DataFrame, row_id: str, strata: Sequence[str], k: Column | int, weight: Column | None = None, seed: int = 0
) -> DataFrame:
    """``k`` rows of each stratum (all, if fewer), with ``priority`` and ``represents``.

    Without ``weight`` every row of a stratum is as likely, and ``represents`` is how many rows each stands for;
    with it, rows are drawn by weight without replacement, rows of weight zero or null never, and ``represents``
    is null. Ids should be distinct: rows that share an id share its draw.
    """
    draw = -F.ln(uniform(F.col(row_id), seed))
    ranked = rows.withColumn("priority", draw if weight is None else draw / weight)
    if weight is not None:
        ranked = ranked.filter(F.coalesce(weight > 0, F.lit(False)))
    found = bottom_k(ranked, strata, k, tie=row_id)
    if weight is not None:
        return found.withColumn("represents", F.lit(None).cast("double"))
    totals = rows.groupBy(F.struct(*strata).alias("_stratum")).agg(F.count(F.lit(1)).alias("_all"))
    taken = Window.partitionBy(*strata)  # at most k rows
    named = found.withColumn("_stratum", F.struct(*strata)).join(totals, "_stratum")
    return named.withColumn("represents", F.col("_all") / F.count(F.lit(1)).over(taken)).drop("_stratum", "_all")


def merged_sample(parts: Sequence[DataFrame], row_id: str, strata: Sequence[str], k: Column | int) -> DataFrame:
    """The sample of all rows from samples of disjoint parts, each of at least ``k`` rows a stratum.

    ``represents`` adds up: a row of a part stands for its share of all rows of the stratum.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    stratum = Window.partitionBy(*strata)  # at most k rows of each part
    whole = whole.withColumn("_all", F.sum("represents").over(stratum))
    found = bottom_k(whole, strata, k, tie=row_id)
    return found.withColumn("represents", F.col("_all") / F.count(F.lit(1)).over(stratum)).drop("_all")
