"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a string of ``bits`` signs of random projections; a tree is the sorted
array of these strings. A query descends every tree to its longest prefix match, then all trees ascend
together, one prefix bit at a time, until their matches are enough. The range of a prefix in a sorted
array is found by two binary searches, and matches have variable length: dense regions stop deep,
sparse ones climb. What is found is ranked by the exact cosine.

The index is dealt to blocks of about ``block`` vectors, and every block has a forest of its own; the
stated query set is dealt to blocks too, and a group holds one of each. So memory is bounded, and as
every block returns the same share of its vectors, recall does not fall as the table grows. The
projections come from a seed; nothing is fitted. Of exact copies of a vector only the ``k + 1``
smallest ids can be among the answers, so a vector that a third of all rows share is few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.llm.common import stored


@dataclass(frozen=True)
class Forest:
    """``enough`` is the share of a block's vectors, counted once per tree, at which ascent ends."""

    trees: int = 64
    bits: int = 32
    block: int = 8192
    queries: int = 2048
    enough: float = 0.45
    seed: int = 11


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def strings(vectors, forest: Forest):
    """Hash strings as integers, first bit highest: one row per tree, one column per vector."""
    import numpy as np

    rng = np.random.default_rng((forest.seed, vectors.shape[1]))
    out = np.zeros((forest.trees, len(vectors)), np.uint64)
    for t in range(forest.trees):
        plane = rng.standard_normal((vectors.shape[1], forest.bits))
        signs = (vectors @ plane > 0).astype(np.uint64)
        out[t] = signs @ (np.uint64(1) << np.arange(forest.bits - 1, -1, -1, dtype=np.uint64))
    return out


def candidates(index, queries, forest: Forest, least: int = 0):
    """Positions in ``index`` that the forest finds for each of ``queries`` (unit vectors).

    All trees ascend until they hold ``enough`` and, on average, ``least`` vectors each.
    """
    import numpy as np

    arrays = strings(index, forest)
    order = np.argsort(arrays, axis=1, kind="stable")
    arrays = np.take_along_axis(arrays, order, axis=1)
    wanted = strings(queries, forest)
    low = np.zeros((forest.trees, len(queries)), np.int64)
    high = np.zeros_like(low)
    climbing = np.arange(len(queries))
    for level in range(forest.bits, -1, -1):  # prefix length: from whole strings up to the root
        if not len(climbing):
            break
        shift = np.uint64(forest.bits - level)
        for t in range(forest.trees):
            prefix = wanted[t, climbing] >> shift << shift
            low[t, climbing] = np.searchsorted(arrays[t], prefix)
            high[t, climbing] = np.searchsorted(arrays[t], prefix + (np.uint64(1) << shift))
        found = (high[:, climbing] - low[:, climbing]).sum(axis=0)
        climbing = climbing[found < forest.enough * len(index) + forest.trees * least]
    for q in range(len(queries)):
        seen = np.zeros(len(index), bool)
        for t in range(forest.trees):
            seen[order[t, low[t, q] : high[t, q]]] = True
        yield np.flatnonzero(seen)


def search_block(ids, vectors, query_ids, queries, k: int, forest: Forest):
    """(query, id, score) rows: the ``k`` nearest candidates of a block for each query.

    A query may meet itself and ``k`` copies in every tree; twice that many are asked for, so ``k``
    others are found wherever there are so many.
    """
    import numpy as np

    norms, own = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    units, asked = vectors / norms[:, None], queries / own[:, None]
    for q, places in enumerate(candidates(units, asked, forest, 2 * (k + 1))):
        places = places[ids[places] != query_ids[q]]
        near = units[places] @ asked[q]
        if len(places) > k:
            # everything as good as the k-th, within rounding, so that ties are settled by id below
            places = places[near >= np.partition(near, -k)[-k] - 1e-12]
        exact = (vectors[places] * queries[q]).sum(axis=1) / (norms[places] * own[q])
        first = np.lexsort((ids[places], -exact))[:k]
        for i in first:
            yield query_ids[q], ids[places[i]], exact[i]


def nearest(
    table: DataFrame, asked: Column, k: int = 5, forest: Forest = Forest(), row_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``asked`` holds.

    Largest cosine of the original vectors in double precision, ties to the smaller id; every row but
    those with the query's own id is a candidate. Rows with a null id, and vectors that are null,
    zero or hold null or non-finite components, take no part; vectors of different lengths are never
    compared. Repeated rows are one. Other columns are ignored, an empty table gives an empty result.
    """
    rows = table.filter(F.col(row_id).isNotNull() & usable(F.col(vector))).select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")
    )
    rows = stored(rows.distinct(), "vectors")
    copies = Window.partitionBy("vector").orderBy("id")
    index = rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).select("id", "vector")
    asking = rows.filter("asked").select("id", "vector")
    blocks = max(1, -(-rows.count() // forest.block))
    groups = max(1, -(-asking.count() // forest.queries))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    turn = F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(groups)).cast("int")
    # blocks of the stated query set against blocks of all rows
    left = index.select(mine.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.size("vector").alias("dims"), "id", "vector")
    right = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), turn.alias("group"), F.size("vector").alias("dims"), "id", "vector")

    def search(some, queries):
        import numpy as np
        import pandas as pd

        found = []
        if len(some) and len(queries):
            found = list(
                search_block(
                    some["id"].to_numpy(), np.array(some["vector"].tolist()), queries["id"].to_numpy(), np.array(queries["vector"].tolist()), k, forest
                )
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["block", "group", "dims"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
