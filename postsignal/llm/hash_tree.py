"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with ``u``
from a hash of the row's id and the child's path, and the smallest draw wins, so a child gets rows in
proportion to its weight. A changed weight moves rows only between that child and its siblings, and
only rows of the subtrees that changed. Id and tree decide the place; nothing else about the table
does, so shards can be filled in any order and at any time.

Growing by one shard adds a region that holds it alone. All other weights stay, so a row either keeps
its place or moves into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.llm.common import stored

#: Rows that are numbered in one task.
NUMBERED = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is set on leaves, whose weight is ``own``."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else self.own)


def tree(weights: list[float], racks: int = 2, regions: int = 4) -> Node:
    """A tree whose leaves are shards 0, 1, ... with the given weights, dealt to racks in order."""
    leaves = [Node(f"shard-{i}", shard=i, own=w) for i, w in enumerate(weights)]
    groups = racks * regions
    edges = [round(i * len(leaves) / groups) for i in range(groups + 1)]
    filled = [leaves[a:b] for a, b in zip(edges, edges[1:])]
    out = []
    for r in range(regions):
        held = [Node(f"rack-{r}-{k}", tuple(filled[r * racks + k])) for k in range(racks) if filled[r * racks + k]]
        if held:
            out.append(Node(f"region-{r}", tuple(held)))
    return Node("root", tuple(out))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The same tree with one more shard, in a region and rack of its own."""
    shard = 1 + max(leaf.shard for region in root.children for rack in region.children for leaf in rack.children)
    new = Node(f"region-of-{shard}", (Node(f"rack-of-{shard}", (Node(f"shard-{shard}", shard=shard, own=weight),)),))
    return Node("root", (*root.children, new))


def _draw(key: Column, child: Node) -> Column:
    """An exponential variable of rate ``weight``, the same whenever id and child are."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / child.weight


def place(key: Column, node: Node) -> Column:
    """The shard that a row with this id falls into. Null ids are one id."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    least = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    chosen = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, child in enumerate(node.children):
        chosen = chosen.when(least == i, place(key, child))
    return chosen


def numbered(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Add the place of each row within its shard, from 0 without gaps.

    Rows of a shard are dealt to chunks by a hash and numbered inside each; chunk sizes, one small row
    per chunk, give the offsets. The number of chunks follows the number of rows.
    """
    rows = stored(rows, "placed-rows")
    shards = max(1, rows.select(shard).distinct().count())
    chunks = max(1, -(-rows.count() // (NUMBERED * shards)))
    chunked = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = chunked.groupBy(shard, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_chunk").orderBy(*order)
    local = chunked.withColumn("_local", F.row_number().over(inside) - 1)
    return (
        local.join(offsets, [shard, "_chunk"])
        .withColumn(slot, F.col("_local") + F.col("_offset"))
        .drop("_chunk", "_local", "_offset")
    )


def shard_rows(docs: DataFrame, root: Node, doc_id: str = "doc_id", text: str = "text", grow: float | None = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus one (a null text has length 0, and the checksum of the empty
    text). The law is ``key``: equal ids share a shard, null ids too, and copies of a text under
    different ids need not. ``grown_shard`` is the place in the tree with one more shard of weight
    ``grow`` (null if ``grow`` is None). Repeated rows get a slot each. Other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, root).alias("shard"),
        (F.lit(None).cast("int") if grow is None else place(key, grown(root, grow))).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"])
