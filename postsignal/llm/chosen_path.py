"""Near-duplicates by a chosen-path join of shingle sets.

Documents are branched down ``trees`` independent trees. A node of a tree selects a position by its own
path, and each of its documents goes to the child of the token, the smallest value that the position's
permutation gives its set. With chance 1/s - 1 the node selects a second position, so that a pair of
similarity s shares one child on average at every level while other pairs part. Nodes of at most ``LEAF``
documents are compared exhaustively. So are nodes that hardly shrink any more, since their documents are
near copies of each other; these are the only large ones, and ``set_links`` finds their links by leaders
and forests, not by pairs. Every link is confirmed on the full sets, so trees decide on recall alone.

A pair at the least similarity of 0.85 shares a first node with chance 0.85 and stays together down to
level 2, 4 and 8 with chance 0.74, 0.59 and 0.43; 16 trees miss it with chance below 10^-9, 10^-6 and 2 * 10^-4.
Closer pairs, and pairs that are also joined through a third text, are surer. Sketches (two bits of 64
positions) pass a pair of that similarity but for one in 10^7; they spare the sets of pairs far from it.

Equal word sequences are one node of the join. Memory of a task is bounded by two chunks of shingle sets.
Null texts, and texts without words, have an empty set and are linked with nothing. Rows repeated come back
repeated. Null ids come back as null, with the smallest id of their component. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm import set_links
from postsignal.llm.common import rows_of, stored

WORDS = 3
PERCENT = 85
TREES = 16
POSITIONS = 64
LEAF = 512
#: Share of its parent from which a large node counts as near copies of each other.
DENSE = 0.75
#: Levels after which nodes are compared whatever their size.
DEPTH = 20


def tokens_and_sketch(hashes, a, b) -> tuple[bytes, bytes]:
    """Four bytes for each position, and two bits of each as a sketch."""
    import numpy as np

    least = set_links.minima(hashes, a, b)
    bits = ((least >> np.uint64(20)) & np.uint64(3)).astype(np.uint8)
    sketch = np.packbits(np.stack([bits >> 1, bits & 1], axis=1).reshape(-1))
    return (least >> np.uint64(32)).astype(">u4").tobytes(), sketch.tobytes()


def most_apart(percent: float, positions: int = POSITIONS) -> int:
    """Sketch bits in which a pair of the similarity may differ: six standard deviations over the mean."""
    miss = 1 - percent / 100
    return min(2 * positions, int(positions * miss + 6 * (positions * (1.5 * miss - miss * miss)) ** 0.5))


def _alike(percent: float):
    apart = most_apart(percent)

    def alike(p, q):
        import numpy as np

        return np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64) <= apart

    return alike


def _nodes(lists: DataFrame) -> DataFrame:
    """Written ``lists`` (key, node, parent) of tree nodes with several documents, with their size and leader."""
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.max("parent").alias("parent")).filter("n > 1")
    dense = F.col("n") >= DENSE * F.col("parent")
    marked = sizes.select("key", "n", "leader", ((F.col("n") <= LEAF) | F.coalesce(dense, F.lit(False))).alias("leaf"))
    return stored(lists.select("key", "node").join(stored(marked, "tree-nodes"), "key"), "tree-entries")


def leaves(heads: DataFrame, percent: float = PERCENT, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(key, node, n, leader): the leaves of all trees with the documents that reach them.

    ``heads`` is (node, tokens).
    """
    token = lambda p: F.substring("tokens", 4 * p + 1, 4)
    first = F.array(*[F.xxhash64(F.lit(t), token(t * POSITIONS // trees)) for t in range(trees)])
    level = _nodes(heads.select("node", F.explode(first).alias("key"), F.lit(None).cast("long").alias("parent")))
    found = [level.filter("leaf")]
    twice = int(1000 * (100 / percent - 1))
    for _ in range(depth - 1):
        large = level.filter("not leaf")
        if large.isEmpty():
            return _union(found)
        position = F.pmod(F.xxhash64("key", F.lit("position")), F.lit(POSITIONS))
        other = F.pmod(position + 1 + F.pmod(F.xxhash64("key", F.lit("other")), F.lit(POSITIONS - 1)), F.lit(POSITIONS))
        both = F.pmod(F.xxhash64("key", F.lit("twice")), F.lit(1000)) < twice
        chosen = large.select("key", "node", "n", F.explode(F.when(both, F.array(position, other)).otherwise(F.array(position))).alias("p"))
        chosen = chosen.join(heads.select("node", "tokens"), "node")
        child = F.xxhash64("key", "p", F.expr("substring(tokens, cast(4 * p + 1 as int), 4)"))
        level = _nodes(chosen.select("node", child.alias("key"), F.col("n").alias("parent")))
        found.append(level.filter("leaf"))
    return _union([*found, level.filter("not leaf")])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select("key", "node", "n", "leader")


def _members(docs: DataFrame, doc_id: str, text: str, words: int, percent: float, trees: int) -> DataFrame:
    """(doc_id, text_key, row, weight, root) of every row; root is null for empty sets."""
    a, b = set_links.permutations(POSITIONS)
    rows, heads = set_links.numbered(docs, words, {"tokens": "binary", "sketch": "binary"}, lambda h: tokens_and_sketch(h, a, b), doc_id, text)
    entries, alike = leaves(heads, percent, trees), _alike(percent)

    def sets(wanted):
        return set_links.sets_of(docs, heads, wanted, words, doc_id, text)

    tried = set_links.leader_pairs(entries, heads, alike, percent)
    links = set_links.verified(tried, sets(set_links.nodes_in(tried)), percent)
    roots = set_links.rooted(heads, links)
    more = set_links.cross_links(entries.filter("n > 2"), heads, roots, sets, alike, percent)
    roots = set_links.rooted(heads, links.union(more))
    named = stored(heads.select("node", "digest").join(roots, "node").select("digest", "root"), "rooted-digests")
    return rows.join(named, "digest", "left")


def similar_sets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: float = PERCENT, trees: int = TREES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Sets of distinct word shingles link where 100 * intersection >= ``percent`` * union. Kept is the row
    whose id is that of its component (null equals null).
    """
    members = stored(_members(docs, doc_id, text, words, percent, trees), "members")
    least = members.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return members.join(least, "root", "left").select(
        "doc_id", F.col("weight").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: float = PERCENT, trees: int = TREES) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the smallest id of each component, and all empty sets.

    A component of null ids keeps one row; repeated rows are one.
    """
    members = _members(docs, doc_id, text, words, percent, trees)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = members.filter("root is not null").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key")
    return rows_of(docs, first.union(members.filter("root is null").select("doc_id", "text_key")), doc_id, text)
