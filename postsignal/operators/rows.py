"""Turning arrays into rows, and joining rows with facts of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task may get in ``join_keyed``.
HOT_ROWS = 100_000


def exploded(df: DataFrame, items: Column, name: str, *keep: str, position: str | None = None) -> DataFrame:
    """One row per non-null item of a computed array, with the ``keep`` columns.

    For a plain explode Spark adds the filter ``size(items) > 0`` below it, which evaluates an
    expensive array expression a second time on every row; an outer explode followed by a null
    check does not.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.filter(F.col(name).isNotNull())


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a costly computed column without moving the computation.

    A plain filter on a computed column is pushed below the projection that computes it, and
    the whole expression is evaluated again for every column it reads. A condition on the output
    of a generator stays where it is.
    """
    mark = F.when(condition, F.array(F.lit(True)))
    return df.select("*", F.explode_outer(mark).alias("_keep")).filter("_keep is not null").drop("_keep")


def join_keyed(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str = "n", how: str = "inner", hot: int | None = None) -> DataFrame:
    """``rows`` with the one row of ``facts`` for each key; its column ``count`` says how many rows the key has.

    Rows of keys with more than ``hot`` rows (default ``HOT_ROWS``) stay where they are and get their facts by
    broadcast; there is at most one such key for each ``hot`` rows. All others are dealt by key. ``rows`` is
    read twice and ``facts`` three times: both should be written tables. ``how`` is inner or left.
    """
    hot = HOT_ROWS if hot is None else hot
    busy = facts.filter(F.col(count) > hot).drop(count)
    if busy.isEmpty():
        return rows.join(facts.drop(count), [*keys], how)
    there = rows.join(F.broadcast(busy), [*keys])
    rest = rows.join(F.broadcast(busy.select(*keys)), [*keys], "left_anti")
    return there.unionByName(rest.join(facts.filter(F.col(count) <= hot).drop(count), [*keys], how))
