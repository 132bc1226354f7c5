"""Features of typed graphs: decayed edges, metapath counts and personalized PageRank.

Nodes and edges are tables and every step is a join on a node with a sum per node, combined on the map side,
so a node with a third of all edges receives one row per task. The edges are a written table, and so are the
ranks they meet: adaptive execution splits the edges of a node with very many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.runtime import written

#: Walks whose flows are columns of one table.
WALKS = 8

#: Edges of a node in one row of the transitions.
EDGES = 1024


def decayed_edges(
    links: DataFrame, src: Column, dst: Column, kind: Column, age: Column, half_life: float, kind_weights: Mapping[str, float] | None = None
) -> DataFrame:
    """(src, dst, kind, weight): one edge per pair and kind, the sum of its links halved every ``half_life``.

    ``kind_weights`` scales kinds; those it does not name weigh 1. Links without an end are left out, links
    of the future count as new.
    """
    scale = F.lit(1.0)
    for name, value in (kind_weights or {}).items():
        scale = F.when(kind == name, float(value)).otherwise(scale)
    weight = scale * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life)
    rows = links.select(src.alias("src"), dst.alias("dst"), kind.alias("kind"), weight.alias("w")).filter("src is not null and dst is not null")
    return rows.groupBy("src", "dst", "kind").agg(F.sum("w").alias("weight"))


def metapath_degrees(edges: DataFrame, path: Sequence[str]) -> DataFrame:
    """(node, paths): weighted number of paths from each node along the kinds of ``path``.

    Counts flow back from the ends of the path, one kind of edge at a time, so no pair of ends is
    ever a row. The weight of a path is the product of its edges' weights.
    """
    reached = None
    for kind in reversed(path):
        step = edges.filter(F.col("kind") == kind)
        if reached is None:
            flow = step.select(F.col("src").alias("node"), F.col("weight").alias("w"))
        else:
            flow = step.join(reached.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), (F.col("weight") * F.col("paths")).alias("w"))
        reached = written(flow.groupBy("node").agg(F.sum("w").alias("paths")), "paths")
    return reached


def degrees(edges: DataFrame) -> DataFrame:
    """(node, kind, out_degree, in_degree, out_weight, in_weight) of every node and kind."""
    out = edges.select(F.col("src").alias("node"), "kind", F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0.0).alias("iw"))
    back = edges.select(F.col("dst").alias("node"), "kind", F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("ow"), F.col("weight").alias("iw"))
    return out.union(back).groupBy("node", "kind").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("ow").alias("out_weight"), F.sum("iw").alias("in_weight")
    )


def _numbered_walks(given: DataFrame) -> tuple[DataFrame, int]:
    """(walk, block, slot) of every walk, ``WALKS`` of them to a block, and the number of walks."""
    walks = written(given.select("walk").distinct(), "walks")
    n = walks.count()
    # numbers run on within a partition; only beyond a hundred thousand names are there several
    numbers = walks.repartition(1 + n // 100_000).select("walk", F.monotonically_increasing_id().alias("_n"))
    return written(numbers.select("walk", F.floor(F.col("_n") / WALKS).alias("block"), (F.col("_n") % WALKS).cast("int").alias("slot")), "numbered-walks"), n


def _transitions(moves: DataFrame, nodes: DataFrame, damping: float) -> DataFrame:
    """(src, dsts, shares): the edges of a node by number, at most about ``EDGES`` of them in a row."""
    known = moves.join(nodes.select(F.col("node").alias("src"), F.col("id").alias("_s")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("_d")), "dst")
    known = written(known.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight"), "numbered-moves")
    out = known.groupBy("src").agg(F.sum("weight").alias("out"), F.ceil(F.count(F.lit(1)) / EDGES).alias("parts"))
    share = F.struct("dst", (damping * F.col("weight") / F.col("out")).alias("share"))
    rows = known.join(out, "src").groupBy("src", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part")).agg(F.collect_list(share).alias("to"))
    return written(rows.select("src", F.col("to.dst").alias("dsts"), F.col("to.share").alias("shares")), "transitions")


def personalized_pagerank(
    edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 200, steps: int = 6
) -> DataFrame:
    """(walk, node, rank): where random walks that restart at the seeds of each walk are found.

    ``edges`` is (src, dst, weight), parallel edges add up and weights not above zero do not count. ``seeds`` is
    (walk, node, weight); weights are normalised within a walk, and all walks are computed together. A walker
    follows an edge by weight with probability ``damping``, else returns to the seeds; at a node without edges
    it always returns. Ranks of a walk sum to one; nodes it cannot reach have no row.

    Both returns lead to the seeds alike, so the ranks are in proportion to the visits of a walk that is
    never sent back: the sum over all lengths of the damped flow. A step adds the seeds to the flow along the
    edges, so it is one join and one sum. Nodes are numbers, the edges of a node are a few rows of arrays and
    the flows of ``WALKS`` walks are columns: a step joins and sorts a row for each node, and makes a row for each edge, not
    for each edge and walk. Every ``steps`` steps the table is written; it ends when what still moves can change no walk
    by more than ``tolerance`` of its sum, or after ``rounds`` steps. Only that share reaches the driver.
    """
    moves = written(edges.filter("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "moves")
    given = written(seeds.filter("weight > 0").groupBy("walk", "node").agg(F.sum("weight").alias("weight")), "seeds")
    ends = moves.select(F.col("src").alias("node"), F.lit(True).alias("leaves")).union(moves.select("dst", F.lit(False))).union(given.select("node", F.lit(False)))
    nodes = ends.groupBy("node").agg(F.max("leaves").alias("leaves")).filter("node is not null")
    nodes = written(nodes.select("node", "leaves", F.monotonically_increasing_id().alias("id")), "nodes")
    transitions = _transitions(moves, nodes, damping)
    numbers, n = _numbered_walks(given)
    flows = [f"f{i}" for i in range(max(1, min(n, WALKS)))]
    keys = ["block", "id"] if n > WALKS else ["id"]
    whole = given.groupBy("walk").agg(F.sum("weight").alias("whole"))
    start = given.join(whole, "walk").join(numbers, "walk").join(nodes, "node").withColumn("_w", F.col("weight") / F.col("whole"))
    home = written(start.groupBy(*keys).agg(*[F.sum(F.when(F.col("slot") == i, F.col("_w")).otherwise(0.0)).alias(f) for i, f in enumerate(flows)]), "home")

    def step(visits: DataFrame) -> DataFrame:
        met = visits.withColumnRenamed("id", "src").join(transitions, "src").select(*keys[:-1], *flows, "shares", F.posexplode("dsts").alias("_i", "id"))
        moved = met.select(*keys, *[(F.col(f) * F.get("shares", F.col("_i"))).alias(f) for f in flows])
        return moved.unionByName(home).groupBy(*keys).agg(*[F.sum(f).alias(f) for f in flows])

    def moving(visits: DataFrame) -> float | None:
        """The largest share of a walk that would flow in the next step: what leaves its nodes, less what came from others."""
        stays = F.when(F.col("leaves"), 1.0 - damping).otherwise(1.0)
        sums = visits.join(nodes, "id").groupBy(*keys[:-1]).agg(*[(F.when(F.sum(f) > 0, 1.0 - F.sum(F.col(f) * stays)) / F.sum(f)).alias(f) for f in flows])
        return sums.select(F.array_max(F.array(*flows)).alias("left")).agg(F.max("left")).first()[0]

    visits = home
    for _ in range(-(-rounds // steps)):
        for _ in range(steps):
            visits = step(visits)
        visits = written(visits, "visits")
        left = moving(visits)
        if left is None or 2 * left / (1 - damping) <= tolerance:
            break
    block = F.col("block") if n > WALKS else F.lit(0)
    each = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f).alias("visits")) for i, f in enumerate(flows)])
    ranks = visits.select("id", block.cast("long").alias("block"), F.explode(each).alias("_e")).select("id", "block", "_e.*").filter("visits > 0")
    total = ranks.groupBy("block", "slot").agg(F.sum("visits").alias("total"))
    named = ranks.join(total.join(numbers, ["block", "slot"]), ["block", "slot"]).join(nodes, "id")
    return named.select("walk", "node", (F.col("visits") / F.col("total")).alias("rank")).filter("rank > 0")
