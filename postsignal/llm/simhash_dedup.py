"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight bytes at eight positions. Two fingerprints that differ in at most
``DISTANCE`` = 4 bits differ in at most four bytes, so they share at least four positional bytes:
the guaranteed minimum. Of any seven positions they then share three. The inverted index therefore
has one posting list for every three of the first seven positions and their bytes (35 keys per
fingerprint; lists under a single byte would hold a 256th of all fingerprints each and make the tally
quadratic). Inside a list the shared positional bytes of each pair are tallied, pairs below four are
dropped, and the bits of the rest are compared.

Copies share a fingerprint, so the index works on distinct fingerprints and a group of copies is one
entry. A long list (near copies of one text) is cut into chunks by a salt, and every pair of chunks is
one small group, so no task ever holds a whole list. A group returns the links of a spanning forest
of its near pairs, not the pairs: components are the same, and what it returns is no more than what
it read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import rows_of, stored, text_key, text_slices, worker_state
from postsignal.llm.graph import smallest_reachable

WORDS = 4
DISTANCE = 4
SEED = 42
#: Bytes of text that are Python objects at once.
BATCH_BYTES = 1 << 21
#: Fingerprints of a posting list that meet in one group.
CHUNK = 512
FEWEST = 8 - DISTANCE
POSITIONS = 7  # positions that keys are made of
KEYED = FEWEST - (8 - POSITIONS)  # positions of them that a near pair shares at least


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the XXH64 bits of the word shingles of an ASCII-lower-cased text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum([len(x) + 1 for x in parts])
    starts = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, bits), the fingerprint as a signed long; of null texts it is zero."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_state(("simhash",), dict)  # nothing is kept
        for batch in batches:
            found = [fingerprint(x) for _, _, texts in text_slices(batch.column(2), BATCH_BYTES) for x in texts]
            found = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_key", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, bits long")


def posting_lists(values: DataFrame) -> DataFrame:
    """(positions, key, bits): every fingerprint under three of its first seven positional bytes."""
    masks = [sum(0xFF << 8 * (7 - p) for p in chosen) for chosen in combinations(range(POSITIONS), KEYED)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("positions"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    return values.select("bits", F.explode(keys).alias("_k")).select("_k.positions", "_k.key", "bits")


def _forest(a, b, same: bool):
    """Links of a spanning forest of the near pairs between ``a`` and ``b`` (or within ``a``)."""
    import numpy as np

    nodes = a if same else np.concatenate([a, b])
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(a)):
        others = a[i + 1 :] if same else b
        shift = i + 1 if same else len(a)
        xor = others ^ a[i]
        shared = (xor.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = np.flatnonzero(shared >= FEWEST)
        near = near[np.bitwise_count(xor[near]) <= DISTANCE]
        for j in near.tolist():
            x, y = find(i), find(j + shift)
            if x != y:
                parent[y] = x
                out.append((int(nodes[i]), int(nodes[j + shift])))
    return out


def near_links(values: DataFrame) -> DataFrame:
    """(x, y): fingerprints at most ``DISTANCE`` bits apart, enough to connect all that are connected.

    ``values`` holds distinct fingerprints as ``bits``.
    """
    lists = posting_lists(values)
    sizes = stored(lists.groupBy("positions", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "posting-sizes")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    held = lists.join(sizes, ["positions", "key"]).withColumn("chunks", chunks)
    mine = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    # a group for every pair of chunks (i <= j); each entry goes to the groups of its own chunk
    spread = held.withColumn("mine", mine).select(
        "positions", "key", "bits", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    grouped = spread.select(
        F.col("positions").cast("int").alias("positions"), "key", F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("right"), "bits",
    )

    def link(batches):
        """Groups of a partition, sorted by key, one after the other; a group may span batches."""
        import numpy as np

        def done(parts):
            bits = np.concatenate([p[0] for p in parts])
            right = np.concatenate([p[1] for p in parts])
            return _forest(bits[~right], bits[right], not right.any())

        open_key, parts, out = None, [], []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            right = batch.column(4).to_numpy(zero_copy_only=False)
            bits = batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                key = tuple(keys[a].tolist())
                if key != open_key and parts:
                    out += done(parts)
                    parts = []
                open_key = key
                parts.append((bits[a:b], right[a:b]))
            if len(out) > 100_000:
                yield _links(out)
                out = []
        if parts:
            out += done(parts)
        yield _links(out)

    def _links(found):
        import numpy as np
        import pyarrow as pa

        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    together = grouped.repartition("positions", "key", "i", "j").sortWithinPartitions("positions", "key", "i", "j")
    return together.mapInArrow(link, "x long, y long").distinct()


def _members(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, bits, root, component_id) of every row; root is a fingerprint."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    heads = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("head")), "distinct-fingerprints")
    links = stored(near_links(heads.select("bits")), "fingerprint-links")
    roots = smallest_reachable(links.withColumnsRenamed({"x": "a", "y": "b"})).withColumnsRenamed({"node": "bits"})
    labelled = stored(heads.join(roots, "bits", "left").select("bits", "head", F.coalesce("root", "bits").alias("root")), "labelled-fingerprints")
    least = labelled.groupBy("root").agg(F.min("head").alias("component_id"))
    components = stored(labelled.join(stored(least, "components"), "root").select("bits", "root", "component_id"), "fingerprint-components")
    return prints.join(components, "bits")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest id reachable).

    Documents link when their fingerprints differ in at most four bits; a component is what links
    reach. Empty and null texts have fingerprint zero and link like any other. Rows repeated with one
    id are one document. Other columns of ``docs`` are ignored, null ids come back with the smallest id
    of their component (null if it has none), an empty table gives an empty result.
    """
    return _members(docs, doc_id, text).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the smallest id of each component.

    A component of null ids keeps one row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = _members(docs, doc_id, text).groupBy("root").agg(F.min(order).alias("first"))
    return rows_of(docs, first.select("first.doc_id", "first.text_key"), doc_id, text)
