"""Order-dependent work without a single-task window.

A global or hot-key window sorts all its rows in one task. The helpers here range-partition the
rows on (key, order) instead, so that even one key holding most rows is spread over the
cluster, do the per-chunk work in parallel and then combine one small row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import materialize, shuffle_width


#: Rows of a chunk, and functions composed in one list.
CHUNK_ROWS, FOLDED = 1_000_000, 2_048


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str = "chunk", rows: int = 0
) -> DataFrame:
    """Add the number of the ordered range partition each row falls into.

    (keys, order) must be a total order. Chunks hold about the same number of rows whatever the
    distribution of the keys; within a key, a lower chunk number means earlier rows. ``rows``, where
    it is known, sets the least number of chunks.
    """
    width = max(shuffle_width(df.sparkSession), -(-rows // CHUNK_ROWS))
    ranged = df.repartitionByRange(width, *[F.col(c) for c in (*keys, *order)])
    return ranged.withColumn(chunk, F.spark_partition_id())


def _chunk_offsets(chunked: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Sum of each total over the earlier chunks of the same key; one row per (key, chunk)."""
    sums = chunked.groupBy(*keys, "chunk").agg(*[c.alias(n) for n, c in totals.items()])
    # At most one row per shuffle partition and key: a bounded window.
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys, "chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )


def with_running_sum(
    df: DataFrame, value: str, out: str, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows (excluding the row itself)."""
    # Both the offsets and the rows must see the same chunk bounds: fix them first.
    chunked = materialize(range_chunks(df, keys, order, rows=df.count()))
    offsets = _chunk_offsets(chunked, keys, {"_offset": F.sum(value)})
    inside = (
        Window.partitionBy("chunk", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = chunked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        local.join(offsets, [*keys, "chunk"], "left")
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "chunk")
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return with_running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", out, order, keys).drop("_one")


def fold_clamped(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    scale: Column,
    shift: Column,
    low: float,
    high: float,
    seed: DataFrame | None = None,
    seed_value: float = 1.0,
    out: str = "value",
) -> DataFrame:
    """Apply ``x -> clamp(scale * x + shift, low, high)`` for every row of a key, in order.

    ``scale`` must be positive. Each step is a function ``min(hi, max(lo, a*x + b))``, and such
    functions compose into one of the same form, so runs of rows fold in parallel into one
    (a, b, lo, hi) each, these again by chunk and by groups of chunks, and the last ones by key. The
    number of chunks follows the number of rows, and no list is longer than ``FOLDED``.
    ``seed`` may give start values as (key, seed); other keys start at ``seed_value``.
    """
    steps = df.select(key, *order, scale.cast("double").alias("_a"), shift.cast("double").alias("_b"))
    chunked = range_chunks(steps, [key], order, rows=steps.count())
    # within a chunk, runs of at most FOLDED rows: the window streams over sorted rows
    inside = Window.partitionBy(key, "chunk").orderBy(*order)
    numbered = chunked.withColumn("_run", F.floor((F.row_number().over(inside) - 1) / FOLDED))
    lo, hi = F.lit(float(low)), F.lit(float(high))
    inf = F.lit(float("inf"))

    def compose(acc: Column, f: Column) -> Column:
        def bound(x: Column) -> Column:
            return F.least(f["hi"], F.greatest(f["lo"], f["a"] * x + f["b"]))

        return F.struct(
            (f["a"] * acc["a"]).alias("a"),
            (f["a"] * acc["b"] + f["b"]).alias("b"),
            bound(acc["lo"]).alias("lo"),
            bound(acc["hi"]).alias("hi"),
        )

    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), (-inf).alias("lo"), inf.alias("hi"))

    def folded(rows: DataFrame, keys: Sequence[str], at: Sequence[str], item: Column) -> DataFrame:
        """Functions of each group composed in the order of ``at``; groups hold few functions."""
        lists = rows.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct(*at, item.alias("_f")))).alias("_l"), F.sum("_n").alias("_n")
        )
        return lists.select(*keys, F.aggregate("_l", identity, lambda acc, s: compose(acc, s["_f"])).alias("_f"), "_n")

    single = F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), lo.alias("lo"), hi.alias("hi"))
    level = folded(numbered.withColumn("_n", F.lit(1).cast("long")), [key, "chunk", "_run"], order, single)
    level = folded(level, [key, "chunk"], ["_run"], F.col("_f"))
    level = folded(level.withColumn("_group", F.floor(F.col("chunk") / FOLDED)), [key, "_group"], ["chunk"], F.col("_f"))
    per_key = folded(level, [key], ["_group"], F.col("_f")).withColumnRenamed("_n", "steps")
    if seed is not None:
        per_key = per_key.join(seed, key, "left")
        start = F.coalesce(F.col("seed").cast("double"), F.lit(float(seed_value)))
    else:
        start = F.lit(float(seed_value))
    f = F.col("_f")
    result = F.least(f["hi"], F.greatest(f["lo"], f["a"] * start + f["b"]))
    return per_key.select(key, result.alias(out), "steps")


def with_previous(df: DataFrame, values: Sequence[str], keys: Sequence[str], order: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Add the ``values`` of the row before each row of its keys; null for the first one and for null keys.

    (keys, order) must be a total order. A row finds the one before in its own chunk, or in the last row of the
    nearest earlier chunk of its keys, so a long series is many tasks.
    """
    chunked = materialize(range_chunks(df, keys, order, rows=df.count()))
    held = F.struct(*values)
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = chunked.groupBy(*keys, "chunk").agg(F.max_by(held, F.struct(*order)).alias("_end")).select(*keys, "chunk", F.last("_end").over(earlier).alias("_far"))
    local = chunked.withColumn("_near", F.lag(held).over(inside)).join(ends, [*keys, "chunk"], "left")
    before = F.when(F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("_far"))
    named = [F.col(k).isNotNull() for k in keys]
    kept = F.when(reduce(Column.__and__, named), before) if named else before
    return local.withColumn("_before", kept).select(*df.columns, *[F.col("_before")[v].alias(prefix + v) for v in values])
