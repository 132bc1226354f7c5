"""Near duplicates among 64-bit fingerprints, exactly and without comparing all pairs.

All work happens on *distinct* fingerprints: copies share a fingerprint, so a group of copies
holding a third of all rows is one row here and is re-attached at the end by an equi-join.

Candidate pairs come from blocks of bits. Cut the fingerprint into ``m`` blocks: two values at
distance <= t agree on at least ``m - t`` blocks, so they share a key made of some ``m - t``
blocks. More blocks mean longer, more selective keys and more keys per value; any number loses
nothing. The default is ``SPARE_BLOCKS`` more than the distance; add one for every hundredfold of
distinct values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.functions.ids import hamming
from postsignal.operators.rows import exploded, join_keyed
from postsignal.runtime import materialize, written

BITS = 64
#: Blocks that two near values share at least.
SPARE_BLOCKS = 2


def simhash(docs: DataFrame, doc_id: str, tokens: Column, bits: int = 60) -> DataFrame:
    """SimHash of the distinct tokens of every document: (id, bits).

    A token's digest is the first 15 hex digits of its SHA-256. A bit is set where more than
    half of the digests have it set. All tokens of a document come from one row, so the counts
    are complete before the shuffle.
    """
    rows = exploded(docs, F.array_distinct(tokens), "_t", doc_id)
    digest = F.conv(F.substring(F.sha2("_t", 256), 1, 15), 16, 10).cast("long")
    counts = rows.select(doc_id, digest.alias("_d")).groupBy(doc_id).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.getbit("_d", F.lit(b)).cast("int")).alias(f"_b{b}") for b in range(bits)],
    )
    value = F.lit(0).cast("long")
    for b in range(bits):
        value = value + F.when(F.col(f"_b{b}") * 2 > F.col("_n"), 1 << b).otherwise(0).cast("long")
    return counts.select(doc_id, value.alias("bits"))


def _masks(blocks: int) -> list[int]:
    """Bit masks of ``blocks`` adjacent blocks covering 64 bits, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_keys(values: DataFrame, blocks: int, threshold: int) -> DataFrame:
    """Every value under each of its keys: (algorithm, bits, combo, key)."""
    masks = _masks(blocks)
    combos = []
    for chosen in combinations(range(blocks), blocks - threshold):
        combo = sum(1 << i for i in chosen)
        mask = _signed(sum(masks[i] & ((1 << 64) - 1) for i in chosen))
        combos.append(
            F.struct(F.lit(combo).alias("combo"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key"))
        )
    keys = values.select("algorithm", "bits", F.explode(F.array(*combos)).alias("_k")).select(
        "algorithm", "bits", F.col("_k.combo").alias("combo"), F.col("_k.key").alias("key")
    )
    # Spark takes exploded rows for no more than the values, and would broadcast all keys through the driver
    return keys.hint("merge")


def _equal_blocks(xor: Column, blocks: int) -> Column:
    """Bit i set where block i of both values agrees."""
    out = F.lit(0)
    for i, mask in enumerate(_masks(blocks)):
        out = out + F.when(xor.bitwiseAND(F.lit(mask)) == 0, 1 << i).otherwise(0)
    return out


def _first_common(xor: Column, combo: Column, blocks: int, threshold: int) -> Column:
    """True for the first of the keys two values share, so that a pair is produced once.

    The first shared key consists of the lowest ``blocks - threshold`` agreeing blocks: up to
    the highest block of the combo no other block agrees.
    """
    need = blocks - threshold
    agree = _equal_blocks(xor, blocks)
    # highest set bit of combo: every lower bit on
    below = combo
    for shift in (1, 2, 4, 8):
        below = below.bitwiseOR(F.shiftright(below, shift))
    return F.bit_count(agree.bitwiseAND(below)) == need


def near_pairs(
    fingerprints: DataFrame, threshold: int = 8, blocks: int | None = None, hot_key: int = 20_000
) -> DataFrame:
    """Pairs of distinct fingerprints within the distance: (algorithm, bits_a, bits_b, distance).

    ``bits_a < bits_b``. Values of different algorithms are never paired. Keys holding more than
    ``hot_key`` values are split: their left side is salted and their right side repeated once
    per salt, which spreads the comparisons of one key without losing or repeating a pair.
    """
    values = fingerprints.select("algorithm", "bits").distinct()
    blocks = blocks or threshold + SPARE_BLOCKS
    keys = block_keys(materialize(values), blocks, threshold)
    counted = keys.groupBy("algorithm", "combo", "key").agg(
        F.ceil(F.count(F.lit(1)) / hot_key).cast("int").alias("salts"),
        F.count(F.lit(1)).alias("_n"),
    ).filter("_n > 1").drop("_n")
    # written, so that both sides of the joins are plain tables and hot keys can be split
    sizes = materialize(counted)
    sized = keys.join(sizes, ["algorithm", "combo", "key"])
    left = sized.withColumn("salt", F.pmod(F.xxhash64("bits"), F.col("salts")).cast("int")).withColumnRenamed("bits", "bits_a")
    right = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumnRenamed("bits", "bits_b")
    pairs = left.drop("salts").join(right.drop("salts"), ["algorithm", "combo", "key", "salt"])
    xor = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    return (
        pairs.filter(F.col("bits_a") < F.col("bits_b"))
        .filter(hamming(F.col("bits_a"), F.col("bits_b")) <= threshold)
        .filter(_first_common(xor, F.col("combo"), blocks, threshold))
        .select("algorithm", "bits_a", "bits_b", hamming(F.col("bits_a"), F.col("bits_b")).alias("distance"))
    )


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest node of each node's connected component: (node, root), for nodes with edges.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Only per-node
    minima are aggregated; neighbours of a node are never collected. Rows are written to the
    checkpoint folder each round, and the loop ends when the edges no longer change.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u"), F.col("v")).union(e.select(F.col("v"), F.col("u")))
        if large:
            near = both
            keep = F.col("v") > F.col("u")
        else:
            near = both.filter("v < u")
            keep = F.lit(True)
        # counted, so that the edges of a root with very many stay spread in the join
        least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        linked = join_keyed(near.filter(keep), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            linked = linked.union(least.select("u", F.col("m").alias("v")))
        return linked.filter("u <> v").distinct()

    def fingerprint(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    current = materialize(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct())
    state = fingerprint(current)
    while state[0]:
        # each step reads its edges several times: both are written
        current = materialize(star(materialize(star(current, large=True)), large=False))
        after = fingerprint(current)
        if after == state:
            break
        state = after
    # every remaining edge points from a node to the root of its component
    flat = current.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return flat.union(flat.select(F.col("root").alias("node"), "root")).distinct()


def spanning_links(values: DataFrame, threshold: int = 8, blocks: int | None = None, hot_key: int = 20_000) -> DataFrame:
    """(algorithm, bits_a, bits_b): near values, enough to connect all that near values connect.

    First every value of a key with the smallest value of that key: one row each. A value's label is the
    smallest value it is linked to this way, and the values of a key meet again only where their labels differ,
    so a key full of near copies gives its values one link each and no pairs. Keys of many values are split as in ``near_pairs``.
    """
    blocks = blocks or threshold + SPARE_BLOCKS
    keys = block_keys(materialize(values.select("algorithm", "bits").distinct()), blocks, threshold)
    by = ["algorithm", "combo", "key"]
    sizes = keys.groupBy(*by).agg(F.min("bits").alias("leader"), F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / hot_key).cast("int").alias("salts"))
    entries = written(keys.join(materialize(sizes.filter("n > 1")), by), "key-entries")
    close = hamming(F.col("bits"), F.col("leader")) <= threshold
    first = materialize(entries.filter("bits <> leader").filter(close).select("algorithm", F.col("leader").alias("bits_a"), F.col("bits").alias("bits_b")).distinct())
    # values with one label are linked to it, or are it
    roots = first.groupBy("algorithm", F.col("bits_b").alias("bits")).agg(F.min("bits_a").alias("root"))
    open_keys = entries.filter("n > 2").join(roots, ["algorithm", "bits"], "left").select(*by, "salts", "bits", F.coalesce("root", "bits").alias("root"))
    mixed = open_keys.groupBy(*by).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select(*by)
    rest = written(open_keys.join(mixed, by), "open-entries")
    left = rest.withColumn("salt", F.pmod(F.xxhash64("bits"), F.col("salts")).cast("int")).select(*by, "salt", F.col("bits").alias("bits_a"), F.col("root").alias("root_a"))
    right = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*by, "salt", F.col("bits").alias("bits_b"), F.col("root").alias("root_b"))
    near = (F.col("root_a") < F.col("root_b")) & (hamming(F.col("bits_a"), F.col("bits_b")) <= threshold)
    # one link for each two labels of a key is enough
    found = left.join(right, [*by, "salt"]).filter(near).groupBy("algorithm", "root_a", "root_b").agg(F.min(F.struct("bits_a", "bits_b")).alias("l"))
    return first.unionByName(found.select("algorithm", "l.bits_a", "l.bits_b"))


def cluster(fingerprints: DataFrame, item: str = "item", threshold: int = 8, blocks: int | None = None) -> DataFrame:
    """Cluster id of every item: the smallest item linked to it by a chain of near duplicates.

    ``fingerprints`` holds (item, algorithm, bits). Items with equal fingerprints are joined
    through the fingerprint itself.
    """
    # read for the heads and again for the result: texts are fingerprinted once
    fingerprints = written(fingerprints.select(item, "algorithm", "bits"), "fingerprints")
    # lowest item per distinct fingerprint stands for all its copies; nearly as many as items, so they are not broadcast
    heads = materialize(fingerprints.groupBy("algorithm", "bits").agg(F.min(item).alias("head"))).hint("merge")
    pairs = spanning_links(heads, threshold, blocks)
    a = heads.select("algorithm", F.col("bits").alias("bits_a"), F.col("head").alias("a"))
    b = heads.select("algorithm", F.col("bits").alias("bits_b"), F.col("head").alias("b"))
    edges = pairs.join(a, ["algorithm", "bits_a"]).join(b, ["algorithm", "bits_b"]).select("a", "b")
    roots = components(edges).withColumnRenamed("node", "head")
    labelled = heads.join(roots, "head", "left").select(
        "algorithm", "bits", F.coalesce("root", "head").alias("cluster_id")
    ).hint("merge")
    return fingerprints.join(labelled, ["algorithm", "bits"]).select(item, "cluster_id")
