"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import stored


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``links`` (a, b).

    Rounds of minimum neighbour and pointer jumping. In each round every link hands the smaller
    label of its ends to both ends, and to the nodes that serve as their labels; then labels are
    replaced by the labels of their labels. The number of rounds grows with the logarithm of the
    longest chain in practice. Only minima are aggregated, combined on the map side, so a node with
    links to a third of all rows sends one row per task. Joins read two written tables, so that
    adaptive execution splits the keys of such nodes. Nothing but a count of changes reaches the
    driver.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b"
        )
        # links whose ends disagree, told to the labels themselves: their trees merge
        open_links = stored(
            ends.filter("root_a <> root_b").select(
                F.greatest("root_a", "root_b").alias("node"), F.least("root_a", "root_b").alias("offer")
            ).groupBy("node").agg(F.min("offer").alias("offer")),
            "offers",
        )
        if open_links.isEmpty():
            return labels
        merged = stored(
            labels.join(open_links, "node", "left").select("node", F.coalesce(F.least("root", "offer"), "root").alias("root")),
            "labels",
        )
        labels = _flattened(merged)


def _flattened(labels: DataFrame) -> DataFrame:
    """Every label replaced by the end of its chain; chains halve in each round."""
    while True:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = stored(labels.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "labels")
        moving = not labels.filter("moved").isEmpty()
        labels = labels.drop("moved")
        if not moving:
            return labels
