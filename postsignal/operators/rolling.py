"""Rolling sums over time, bursts and repeats, with long series cut into blocks.

A window over a key would put a hot series into one task. Here time is cut into blocks of several window
lengths; a row counts in its own block and, if it is near the end, is carried into the next one as halo. A
window over (key, block) then sees all rows that it needs, and the blocks of one series are many tasks. Rows
of one key and time are summed before they move, so a block is bounded by its length, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import written

#: Window lengths in a block: one in so many rows is carried.
BLOCK = 16


def rolling_sums(cells: DataFrame, keys: Sequence[str], at: str, width: int, sums: dict[str, Column]) -> DataFrame:
    """Add, to every row of ``cells``, sums over the rows of its keys with ``at - width <= time < at``.

    ``cells`` has one row per keys and time (a whole number). A window without rows gives null.
    """
    length = width * BLOCK
    block = F.floor(F.col(at) / length)
    # the last rows of a block are halo of the next
    nearby = F.when(F.floor((F.col(at) + width) / length) > block, F.array(block, block + 1)).otherwise(F.array(block))
    spread = cells.withColumn("_own", block).withColumn("_block", F.explode(nearby))
    window = Window.partitionBy(*keys, "_block").orderBy(at).rangeBetween(-width, -1)
    summed = spread.select("*", *[F.sum(value).over(window).alias(name) for name, value in sums.items()])
    return summed.filter("_block = _own").drop("_block", "_own")


def counts_per_step(rows: DataFrame, keys: Sequence[str], at: Column, step: int) -> DataFrame:
    """(keys, step, n): rows per key and step of time; rows without time are left out."""
    return rows.withColumn("step", F.floor(at / step)).filter("step is not null").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("n"))


def bursts(
    rows: DataFrame, keys: Sequence[str], at: Column, step: int = 3600, width: int = 24, threshold: float = 3.0, least_std: float = 1.0, least: int = 3
) -> DataFrame:
    """(keys, step, n, mean, std, z, ratio, burst) of every step in which a key has rows.

    ``mean`` and ``std`` are those of the ``width`` steps before, steps without rows included as zero. ``z`` is how
    many standard deviations ``n`` lies above the mean, the deviation taken as at least ``least_std``; ``ratio`` is
    (n + 1) / (mean + 1). A burst has z from ``threshold`` and at least ``least`` rows.
    """
    cells = written(counts_per_step(rows, keys, at, step), "steps")
    summed = rolling_sums(cells, keys, "step", width, {"s": F.col("n"), "q": F.col("n") * F.col("n")})
    mean = F.coalesce("s", F.lit(0)) / width
    staged = summed.withColumn("mean", mean)
    variance = F.coalesce("q", F.lit(0)) / width - F.col("mean") * F.col("mean")
    staged = staged.withColumn("std", F.sqrt(F.greatest(variance, F.lit(0.0))))
    z = (F.col("n") - F.col("mean")) / F.greatest(F.col("std"), F.lit(float(least_std)))
    scored = staged.withColumn("z", z).withColumn("ratio", (F.col("n") + 1) / (F.col("mean") + 1))
    return scored.withColumn("burst", (F.col("z") >= threshold) & (F.col("n") >= least)).drop("s", "q")


def recent_repeats(rows: DataFrame, item: str, keys: Sequence[str], at: Column, width: int = 7200, first_free: int = 2, step: float = 20.0) -> DataFrame:
    """(item, repeats, fatigue): how many rows of the same keys came in the ``width`` seconds before.

    ``at`` is whole seconds; rows of the same second do not count as before. Fatigue is ``step`` for each
    repeat beyond ``first_free``, at most 100. Rows with a null key or time have no repeats.
    """
    timed = written(rows.select(item, *keys, at.alias("_at")), "timed")
    known = timed.dropna(subset=[*keys, "_at"])
    cells = known.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("n"))
    # rows of one moment share its count
    before = written(rolling_sums(cells, keys, "_at", width, {"repeats": F.col("n")}).select(*keys, "_at", "repeats"), "repeats")
    found = timed.join(before, [*keys, "_at"], "left").select(item, F.coalesce("repeats", F.lit(0).cast("long")).alias("repeats"))
    fatigue = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("repeats") - first_free) * float(step)))
    return found.withColumn("fatigue", fatigue)
