"""First-wins and content deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.runtime import materialize


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row of every key in the given total order.

    The rank filter lets Spark keep one row per key on the map side before the shuffle
    (window group limit), so a key holding a third of all rows sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def first_captures(posts: DataFrame, order: Sequence[str] = ("captured_at", "post_id")) -> DataFrame:
    """One row per (platform, platform post id), or per idempotency key where the id is empty.

    Exact for derived keys: equal derived keys imply equal platform ids.
    """
    pid = F.nullif(F.col("platform_post_id"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("p:"), pid), F.concat(F.lit("k:"), F.col("idempotency_key")))
    return first_per_key(posts, [F.col("platform"), key], list(order))


def first_captures_by_either_key(
    posts: DataFrame, order: Sequence[str] = ("captured_at", "post_id")
) -> DataFrame:
    """First-wins when the caller supplies idempotency keys.

    A row is dropped if an *accepted* earlier row shares its idempotency key or its (platform,
    platform post id); a dropped row suppresses nothing. In every round a row that is the
    earliest undecided one under both its keys is accepted, and the rows sharing a key with it
    are dropped, so the loop ends with exactly the result of reading the rows one by one. From the
    second round on, rows that have one earlier undecided row beside them are decided as well: they
    form paths, on which every other row is accepted, and paths are followed by doubling the step. A chain that
    alternates between both keys takes the logarithm of its length. What is left is a round for
    each level of rows that wait for two or more; in an order independent of the keys these are about
    log(n) squared at most, and no form that needs fewer for every order is known.
    """
    pid = F.nullif(F.col("platform_post_id"), F.lit(""))
    rank = F.struct(*[F.col(c) for c in order])
    # Rows without a platform id or an idempotency key get a key of their own.
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    open_rows = materialize(
        posts.select(
            rank.alias("_rank"),
            F.coalesce(F.concat(F.lit("k:"), "idempotency_key"), F.concat(F.lit("o:"), own)).alias("_a"),
            F.coalesce(
                F.concat(F.lit("p:"), F.col("platform"), F.lit("|"), pid), F.concat(F.lit("o:"), own)
            ).alias("_b"),
        )
    )
    rounds: list[DataFrame] = []
    while not open_rows.isEmpty():
        # written, so that the rows of a key with very many can be split in the joins
        seen = open_rows.join(_firsts(open_rows, "_a"), "_a").join(_firsts(open_rows, "_b"), "_b")
        wins = materialize(
            seen.filter((F.col("_rank") == F.col("_first_a")) & (F.col("_rank") == F.col("_first_b"))).select("_rank", "_a", "_b")
        )
        if rounds:
            wins = materialize(wins.unionByName(_accepted_on_paths(seen, wins, open_rows)))
        open_rows = materialize(
            open_rows.join(wins.select("_a"), "_a", "left_anti").join(wins.select("_b"), "_b", "left_anti")
        )
        rounds.append(wins.select("_rank.*"))
    if not rounds:
        return posts.limit(0)
    kept = reduce(DataFrame.unionByName, rounds).toDF(*[f"_kept_{c}" for c in order])
    same = [posts[c].eqNullSafe(kept[f"_kept_{c}"]) for c in order]
    return posts.join(kept, reduce(Column.__and__, same), "left_semi")


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    return materialize(rows.groupBy(key).agg(F.min("_rank").alias("_first" + key)))


def _seconds(seen: DataFrame, key: str) -> DataFrame:
    later = seen.filter(F.col("_rank") > F.col("_first" + key))
    return materialize(later.groupBy(key).agg(F.min("_rank").alias("_second" + key)))


def _accepted_on_paths(seen: DataFrame, wins: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (_rank, _a, _b) accepted because the one earlier row beside them is dropped.

    A row is beside at most two later ones that have no other earlier row, so no join meets a hot row.
    """
    ranked = seen.join(_seconds(seen, "_a"), "_a", "left").join(_seconds(seen, "_b"), "_b", "left")

    def before(key: str) -> Column:
        own, first, second = F.col("_rank"), F.col("_first" + key), F.col("_second" + key)
        return F.when(own == first, 0).when(own == second, 1).otherwise(2)

    a, b = before("_a"), before("_b")
    to = F.when((a == 1) & ((b == 0) | ((b == 1) & (F.col("_first_a") == F.col("_first_b")))), F.col("_first_a")).when(
        (a == 0) & (b == 1), F.col("_first_b")
    )
    steps = materialize(ranked.select("_rank", to.alias("_to")).filter("_to is not null"))
    # how the row ends that a path leads to: accepted, undecided, or null where it is on a path itself
    ends = wins.select(F.col("_rank").alias("_to"), F.lit(True).alias("_won"))
    inner = steps.select(F.col("_rank").alias("_to"), F.lit(True).alias("_inner"))
    end = F.when(F.col("_inner").isNull(), F.coalesce("_won", F.lit(False)))
    paths = materialize(
        steps.join(ends, "_to", "left").join(inner, "_to", "left").select("_rank", "_to", F.lit(True).alias("_odd"), end.alias("_end"))
    )
    while not paths.filter("_end is null").isEmpty():
        onward = paths.select(F.col("_rank").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_more"), F.col("_end").alias("_then"))
        moved = paths.filter("_end is null").drop("_end").join(onward, "_to")
        moved = moved.select("_rank", F.col("_next").alias("_to"), (F.col("_odd") != F.col("_more")).alias("_odd"), F.col("_then").alias("_end"))
        paths = materialize(paths.filter("_end is not null").unionByName(moved))
    accepted = paths.filter(F.col("_end") & ~F.col("_odd")).select("_rank")
    return rows.join(accepted, "_rank", "left_semi").select("_rank", "_a", "_b")


def not_yet_stored(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Arrivals whose idempotency key and (platform, platform post id) are not stored yet.

    The stored table is first cut down to keys that occur among the arrivals. A small batch is
    broadcast for that (Spark's size check decides), so the large table is scanned for its key
    columns only and never shuffled.
    """
    ids = ["platform", "platform_post_id"]
    known_keys = stored.select("idempotency_key").join(
        arrivals.select("idempotency_key"), "idempotency_key", "left_semi"
    )
    known_ids = stored.select(*ids).filter("platform_post_id <> ''").join(arrivals.select(*ids), ids, "left_semi")
    return arrivals.join(known_keys, "idempotency_key", "left_anti").join(known_ids, ids, "left_anti")


def content_objects(
    rows: DataFrame, digest: str = "sha", reference: str = "reference_id", size: str = "byte_size",
    accessed: str = "last_accessed",
) -> DataFrame:
    """One object per content digest with its number of distinct references.

    References are reduced to distinct (digest, reference) pairs before counting; no list of
    references is ever built for one object.
    """
    pairs = rows.groupBy(digest, reference).agg(
        F.max(size).alias(size), F.max(accessed).alias(accessed)
    )
    return pairs.groupBy(digest).agg(
        F.max(size).alias(size),
        F.max(accessed).alias(accessed),
        F.count(reference).alias("reference_count"),
    )
