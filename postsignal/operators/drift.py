"""Drift of numeric and categorical features between a reference and later periods.

A number falls into one of geometric buckets, a few thousand over all sizes, so the counts of the buckets
are a quantile sketch: any two add up to that of all their rows, and a quantile is known to one bucket, a
fixed relative error. One pass counts (segment, period, feature, bucket), combined on the map side. The
bins of a feature are cut at quantiles of the reference's counts, and as bins end where buckets end, all
histograms are exact sums of the same counts: no second pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import written

#: Ratio of neighbouring buckets, and the size below which a number counts as zero.
RATIO, TINY = 1.02, 1e-9
#: Added to every bin's count before shares are compared.
SMOOTH = 0.5


def bucket(value: Column, ratio: float = RATIO, tiny: float = TINY) -> Column:
    """Number of the bucket of a value, in the order of the values; null for nulls and nan."""
    size = F.abs(value)
    place = F.ceil(F.ln(size / tiny) / math.log(ratio))
    signed = F.when(size <= tiny, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * F.greatest(place, F.lit(1).cast("long")))
    finite = F.when(size == float("inf"), F.signum(value).cast("long") * (1 << 40)).otherwise(signed)
    return F.when(value.isNotNull() & ~F.isnan(value), finite)


def sketches(rows: DataFrame, keys: Sequence[str], features: Mapping[str, Column]) -> DataFrame:
    """(keys, feature, bucket, n): mergeable counts of every feature; nulls are a bucket of their own."""
    items = F.array(*[F.struct(F.lit(name).alias("feature"), bucket(value.cast("double")).alias("bucket")) for name, value in features.items()])
    return rows.select(*keys, F.explode(items).alias("_i")).groupBy(*keys, F.col("_i.feature").alias("feature"), F.col("_i.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(*parts: DataFrame) -> DataFrame:
    """The sketch of all rows of several sketches."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*[c for c in parts[0].columns if c != "n"]).agg(F.sum("n").alias("n"))


def _upto(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the sum of counts up to and including each bucket; a feature has a bounded number of them."""
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))


def quantiles(sketch: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(keys, feature, q, bucket): the bucket that holds each quantile of a sketch (null values left out)."""
    counted = _upto(sketch.filter("bucket is not null"), [*keys, "feature"])
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q")
    found = counted.select(*keys, "feature", "bucket", "upto", "all", wanted).filter(F.col("upto") >= F.col("q") * F.col("all"))
    return found.groupBy(*keys, "feature", "q").agg(F.min("bucket").alias("bucket"))


def divergences(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reference_n, current_n, psi, js) from ``cells`` (keys, bin, expected, actual), one row a bin.

    Shares are smoothed, so a bin that one side lacks does not make them infinite. ``psi`` is in nats, ``js`` in
    bits.
    """
    whole = Window.partitionBy(*keys)
    totals = cells.withColumn("e_all", F.sum("expected").over(whole)).withColumn("a_all", F.sum("actual").over(whole)).withColumn("bins", F.count(F.lit(1)).over(whole))
    share = lambda n, all_: (F.col(n) + SMOOTH) / (F.col(all_) + SMOOTH * F.col("bins"))
    shares = totals.withColumn("e", share("expected", "e_all")).withColumn("a", share("actual", "a_all"))
    mid = (F.col("e") + F.col("a")) / 2
    return shares.groupBy(*keys).agg(
        F.first("e_all").alias("reference_n"), F.first("a_all").alias("current_n"), F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"),
        (F.sum(F.col("e") * F.log2(F.col("e") / mid) + F.col("a") * F.log2(F.col("a") / mid)) / 2).alias("js"),
    )


def _cells(counts: DataFrame, periods: DataFrame, segments: Sequence[str], period: str, reference: Column) -> DataFrame:
    """Counts (segments, period, feature, bin, n) beside those of the reference, for all bins of either."""
    by = [*segments, "feature", "bin"]
    expected = counts.filter(reference).groupBy(*by).agg(F.sum("n").alias("expected"))
    # every later period of a feature meets all bins that it or its reference has
    bins = counts.select(*by).distinct().join(periods, [*segments, "feature"])
    actual = counts.filter(~reference).select(*by, period, F.col("n").alias("actual"))
    both = bins.join(expected, by, "left").join(actual, [*by, period], "left")
    return both.select(*by, period, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))


def numeric_drift(
    rows: DataFrame, segments: Sequence[str], period: str, reference: Column, features: Mapping[str, Column], bins: int = 10, major: float = 0.25, moderate: float = 0.1
) -> DataFrame:
    """PSI, JS divergence and KS distance of every (segments, feature, later period) against the reference.

    ``reference`` is a condition on ``period``. Bins are cut at the ``bins``-quantiles of the reference; nulls
    are a bin of their own and take no part in KS. Features that the reference lacks have one bin.
    """
    counts = written(sketches(rows, [*segments, period], features), "sketches")
    keys = [*segments, "feature"]
    base = merged(counts.filter(reference).drop(period))
    cuts = quantiles(base, segments, [i / bins for i in range(1, bins)]).groupBy(*keys).agg(F.array_sort(F.collect_set("bucket")).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c < F.col("bucket")))
    placed = counts.join(written(cuts, "cuts"), keys, "left")
    placed = placed.withColumn("bin", F.when(F.col("bucket").isNull(), -1).otherwise(F.coalesce(place, F.lit(0))))
    placed = placed.groupBy(*keys, period, "bin").agg(F.sum("n").alias("n"))
    periods = counts.filter(~reference).select(*keys, period).distinct()
    found = divergences(_cells(written(placed, "histograms"), periods, segments, period, reference), [*keys, period])
    return _verdict(found.join(_ks(counts, base, keys, period, reference, periods), [*keys, period], "left"), major, moderate)


def _ks(counts: DataFrame, base: DataFrame, keys: Sequence[str], period: str, reference: Column, periods: DataFrame) -> DataFrame:
    """(keys, period, ks): greatest distance of the two distributions at a bucket's end; null if one side has no values."""
    one = base.filter("bucket is not null").join(periods, list(keys)).select(*keys, period, "bucket", F.col("n").alias("e"), F.lit(0).cast("long").alias("a"))
    other = counts.filter(~reference).filter("bucket is not null").select(*keys, period, "bucket", F.lit(0).cast("long").alias("e"), F.col("n").alias("a"))
    by = [*keys, period]
    both = one.unionByName(other).groupBy(*by, "bucket").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    share = lambda n: F.try_divide(F.sum(n).over(upto), F.sum(n).over(whole))
    gap = F.abs(share("e") - share("a"))
    return both.select(*by, gap.alias("gap")).groupBy(*by).agg(F.max("gap").alias("ks"))


def categorical_drift(
    rows: DataFrame, segments: Sequence[str], period: str, reference: Column, features: Mapping[str, Column], major: float = 0.25, moderate: float = 0.1
) -> DataFrame:
    """PSI and JS divergence of categories; each value is a bin, null included.

    A feature whose values are nearly all different is no category: its bins are as many as its values.
    """
    items = F.array(*[F.struct(F.lit(name).alias("feature"), F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")).alias("bin")) for name, value in features.items()])
    exploded = rows.select(*segments, period, F.explode(items).alias("_i")).select(*segments, period, "_i.feature", "_i.bin")
    counts = written(exploded.groupBy(*segments, period, "feature", "bin").agg(F.count(F.lit(1)).alias("n")), "categories")
    periods = counts.filter(~reference).select(*segments, "feature", period).distinct()
    return _verdict(divergences(_cells(counts, periods, segments, period, reference), [*segments, "feature", period]), major, moderate)


def _verdict(found: DataFrame, major: float, moderate: float) -> DataFrame:
    verdict = F.when(F.col("psi") >= major, "major").when(F.col("psi") >= moderate, "moderate").otherwise("stable")
    return found.withColumn("verdict", verdict)
