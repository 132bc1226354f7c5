"""Near-duplicates by the Jaccard similarity of word shingles, over SimHash and positional fingerprints.

Two indexes give candidates. The first is that of ``simhash_dedup``: byte positions of the SimHash of a text's
distinct shingles, tallied, up to four bits apart. Such pairs are nearly equal (similarity from about 0.96). A
SimHash of 64 bits is blind to most of what lies between that and 0.8, so a second index of positional minima adds
the rest. What links is decided by the exact sets alone, whichever index has brought a pair.

A fingerprint of the second index has ``POSITIONS`` bytes; each is the top byte of a mix of the smallest value that one of as
many permutations gives the shingles of a text. Two texts of similarity s share about that share of the
bytes. The inverted index has one posting list for every ``TOGETHER`` neighbouring positions and their
bytes. Pairs that meet in a list are tallied, pairs that share fewer bytes than five standard deviations
below the expected number are dropped, and the rest are compared by their exact sets of shingles: no
pair below the similarity links. By calculation a pair of similarity 0.8 meets in one of the 48 lists but
for one in 10^8 pairs and passes the tally but for about one in 10^6; closer pairs are surer.

A list leaves no pairs: see ``set_links`` for the two rounds in which it is tallied and verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm import set_links
from postsignal.llm.common import rows_of, stored
from postsignal.llm.simhash_dedup import near_links

WORDS = 5
SIMILARITY = 0.8
POSITIONS = 240
TOGETHER = 5


def least_shared(similarity: float, positions: int = POSITIONS) -> int:
    """Bytes that a pair has to share: five standard deviations below the expected number."""
    return max(0, int(positions * similarity - 5 * (positions * similarity * (1 - similarity)) ** 0.5))


def positional(hashes, a, b) -> bytes:
    """One byte for each permutation ``a * x + b`` (mod 2^64): the top byte of its mixed smallest value."""
    import numpy as np

    return (set_links.minima(hashes, a, b) >> np.uint64(56)).astype(np.uint8).tobytes()


def simhash(hashes) -> bytes:
    """Eight bytes: the bits that more than half of the hashes have set."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def simhash_pairs(heads: DataFrame) -> DataFrame:
    """(x, y): nodes whose SimHash values link, by a spanning forest of the values; equal ones with their smallest node."""
    prints = heads.select("node", F.conv(F.hex("simhash"), 16, -10).cast("long").alias("bits"))
    first = stored(prints.groupBy("bits").agg(F.min("node").alias("x")), "simhash-values")
    links = stored(near_links(first.select("bits")).withColumnsRenamed({"x": "of_x", "y": "of_y"}), "simhash-links")
    near = links.join(first.withColumnRenamed("bits", "of_x"), "of_x").join(first.withColumnsRenamed({"bits": "of_y", "x": "y"}), "of_y")
    equal = prints.join(first, "bits").filter("node <> x").select("x", F.col("node").alias("y"))
    return equal.union(near.select("x", "y"))


def posting_lists(heads: DataFrame) -> DataFrame:
    """Written (key, node, n, leader): the lists that hold several nodes, with their length and smallest node."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i + 1, TOGETHER)) for i in range(0, POSITIONS, TOGETHER)])
    lists = heads.select("node", F.explode(keys).alias("key"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).filter("n > 1")
    return stored(lists.join(stored(sizes, "posting-sizes"), "key"), "posting-entries")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, root) of every row: rows of one root are linked by texts of at least the similarity.

    Null texts and texts without words are alike, and their root is null; a text of fewer than ``words``
    words is one shingle. Rows repeated come back repeated, null ids as null; an empty table gives an empty
    result; columns other than id and text are not read, whatever their names. Made for similarities from
    0.8; lower ones miss more pairs.
    """
    a, b = set_links.permutations(POSITIONS)
    rows, heads = set_links.numbered(docs, words, {"sketch": "binary", "simhash": "binary"}, lambda h: [positional(h, a, b), simhash(h)], doc_id, text)
    entries, fewest, percent = posting_lists(heads), least_shared(similarity), 100 * similarity - 1e-7

    def alike(p, q):
        import numpy as np

        return (p == q).sum(axis=-1, dtype=np.int64) >= fewest

    def sets(wanted):
        return set_links.sets_of(docs, heads, wanted, words, doc_id, text)

    near = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    tried = stored(simhash_pairs(heads).union(set_links.leader_pairs(entries, heads, alike, percent)).select(*near).distinct(), "tried-pairs")
    links = set_links.verified(tried, sets(set_links.nodes_in(tried)), percent)
    roots = set_links.rooted(heads, links)
    more = set_links.cross_links(entries.filter("n > 2"), heads, roots, sets, alike, percent)
    roots = set_links.rooted(heads, links.union(more))
    named = stored(heads.select("node", "digest").join(roots, "node").select("digest", "root"), "rooted-digests")
    return rows.join(named, "digest", "left").select("doc_id", "text_key", "root")


def one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the smallest id of each group of similar texts.

    A group of null ids keeps one row (of the smallest text key); repeated rows are one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = similar_groups(docs, doc_id, text, words, similarity).groupBy("root").agg(F.min(order).alias("first"))
    return rows_of(docs, first.select("first.doc_id", "first.text_key"), doc_id, text)
