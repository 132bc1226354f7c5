"""Links between sets of word shingles that meet in groups, found without leaving the pairs of a group.

Groups are posting lists or tree nodes: rows (key, node). A node is one distinct text, named by a row
number, so no two texts share a node whatever their hashes. Every group is searched in two rounds:

* ``leader_pairs``: each node with the smallest node of its group. The order is one for all groups, so a
  group of near copies meets few leaders, and one link a node is enough to hold it together.
* ``cross_links``: pairs of nodes that the first links leave in different components. A group is cut into
  chunks, those of its largest component apart from the rest, and chunks of the largest component do not meet
  each other. In a chunk pair, sketches tell which nodes have a partner at all; only these meet again with
  their whole sets, inside the first group that both are in, and a spanning forest of the links leaves.
  The rows between steps are nodes of groups, never pairs.

No pair is dropped: every pair of a group is held against the sketches, and every one that passes is
either linked by its sets or already in one component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import stored, text_key, text_slices, worker_state
from postsignal.llm.graph import smallest_reachable

SEED = 42
#: Bytes of text that are Python objects at once.
BATCH_BYTES = 1 << 21
#: Nodes and shingles of a chunk.
CHUNK, CHUNK_SHINGLES = 512, 1 << 21


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space of an ASCII-lower-cased text."""
    return text.lower().split()


def shingle_hashes(parts: list[bytes], words: int, seed: int = SEED):
    """Sorted distinct XXH64 values of the word shingles; fewer words are one shingle, none an empty set."""
    from itertools import repeat

    import numpy as np
    from xxhash import xxh64_intdigest

    if not parts:
        return np.zeros(0, np.uint64)
    shingles = [*map(b" ".join, zip(*(parts[k:] for k in range(words))))] or [b" ".join(parts)]
    values = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    values.sort()
    # sorted and held against the value before: np.unique takes ten times as long
    return values[np.append(True, values[1:] != values[:-1])]


def permutations(positions: int):
    """Factors and shifts of as many permutations of 64-bit values."""
    import numpy as np

    rnd = np.random.default_rng(SEED)
    return rnd.integers(0, 1 << 63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, positions, dtype=np.uint64)


def minima(hashes, a, b):
    """The smallest value that each permutation ``a * x + b`` (mod 2^64) gives, mixed."""
    import numpy as np

    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * a + b).min(axis=0), out=least)
    return least * np.uint64(0x9E3779B97F4A7C15)


def numbered(docs: DataFrame, words: int, values: dict[str, str], make: Callable, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written (rows, heads) of ``docs``.

    ``rows`` is (doc_id, text_key, row, digest, weight): one row per row, with 128 bits of the word
    sequence and the number of shingles; the digest is null without words. ``heads`` has one node for each
    digest, the smallest row number: (node, doc_id, text_key, digest, weight, values), where ``make`` turns a
    set of hashes into the values.
    """
    kinds = ", ".join(f"{n} {k}" for n, k in values.items())

    def run(batches):
        import hashlib

        import pyarrow as pa

        worker_state(("set_links",), dict)  # nothing is kept
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), BATCH_BYTES):
                digests, sizes, made = [], [], []
                for x in texts:
                    parts = words_of(x)
                    hashes = shingle_hashes(parts, words)
                    digests.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest() if parts else None)
                    sizes.append(len(hashes))
                    made.append(make(hashes) if parts else [None] * len(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]
                    + [pa.array([m[k] for m in made], pa.binary()) for k in range(len(values))],
                    names=["doc_id", "text_key", "digest", "weight", *values],
                )

    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    prints = raw.mapInArrow(run, f"doc_id long, text_key long, digest binary, weight long, {kinds}")
    written = stored(prints.withColumn("row", F.monotonically_increasing_id()), "prints")
    first = F.min(F.struct(F.col("row").alias("node"), "doc_id", "text_key", "weight", *values)).alias("h")
    heads = stored(written.filter("digest is not null").groupBy("digest").agg(first).select("h.*", "digest"), "distinct-prints")
    return written.drop(*values), heads


def sets_of(docs: DataFrame, heads: DataFrame, wanted: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written (node, set) of the ``wanted`` nodes: their shingle hashes, sorted, as bytes."""
    key = lambda i, t: F.struct(i.alias("id"), t.alias("text")).alias("_key")
    named = heads.join(wanted, "node", "left_semi").select("node", key(F.col("doc_id"), F.col("text_key")))
    texts = docs.select(key(F.col(doc_id).cast("long"), text_key(F.col(text))), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(named, "_key").dropDuplicates(["_key"]).select("node", "text")

    def run(batches):
        import pyarrow as pa

        worker_state(("set_links",), dict)  # nothing is kept
        for batch in batches:
            for a, b, some in text_slices(batch.column(1), BATCH_BYTES):
                sets = pa.array([shingle_hashes(words_of(x), words).tobytes() for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["node", "set"])

    return stored(found.mapInArrow(run, "node long, set binary"), "shingle-sets")


def near(p, q, percent: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent`` of a hundred."""
    import numpy as np

    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _pairs_kept(pairs: DataFrame, held: DataFrame, value: str, keep: Callable) -> DataFrame:
    """The pairs (x, y) for whose values in ``held`` ``keep`` (of two lists of bytes) is true."""
    both = pairs.join(held.select(F.col("node").alias("x"), F.col(value).alias("of_x")), "x").join(
        held.select(F.col("node").alias("y"), F.col(value).alias("of_y")), "y"
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                x, y, p, q = (c.slice(i, 256) for c in batch.columns)
                mask = pa.array(keep(p.to_pylist(), q.to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays([x, y], names=["x", "y"]).filter(mask)

    return both.select("x", "y", "of_x", "of_y").mapInArrow(run, "x long, y long")


def leader_pairs(entries: DataFrame, nodes: DataFrame, alike: Callable, percent: float) -> DataFrame:
    """Written (x, y): nodes with the leaders of their groups, as far as sizes and sketches allow a link.

    ``entries`` is (key, node, leader), ``nodes`` (node, weight, sketch).
    """
    met = entries.filter("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y")).distinct()

    def keep(p, q):
        import numpy as np

        matrix = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        return alike(matrix(p), matrix(q))

    return stored(_pairs_kept(met, nodes, "sketch", keep), "leader-pairs")


def verified(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """Written (x, y): the pairs whose whole sets are as similar as asked."""

    def keep(p, q):
        import numpy as np

        values = lambda x: np.frombuffer(x, np.uint64)
        return [near(values(a), values(b), percent) for a, b in zip(p, q)]

    return stored(_pairs_kept(pairs, sets, "set", keep), "verified-links")


def nodes_in(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "wanted")


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Written (node, root) of all ``nodes`` (node)."""
    roots = smallest_reachable(links.withColumnsRenamed({"x": "a", "y": "b"}))
    return stored(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")


def _chunk_pairs(entries: DataFrame) -> DataFrame:
    """(key, i, j, right, node, root, sketch): the nodes of each chunk pair of the groups that hold several roots."""
    per_root = entries.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    per_key = per_root.groupBy("key").agg(
        F.max_by("root", "n").alias("major"), F.max("n").alias("n_major"), F.max_by("w", "n").alias("w_major"), F.sum("n").alias("n"),
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots"),
    )
    chunks = lambda n, w: (1 + F.floor(n / CHUNK) + F.floor(w / CHUNK_SHINGLES)).cast("int")
    whole = (F.col("n") <= CHUNK) & (F.col("w") <= CHUNK_SHINGLES)
    mixed = per_key.filter("roots > 1").select(
        "key", "major", F.when(whole, 0).otherwise(chunks(F.col("n_major"), F.col("w_major"))).alias("of_major"),
        F.when(whole, 1).otherwise(chunks(F.col("n") - F.col("n_major"), F.col("w") - F.col("w_major"))).alias("of_rest"),
    )
    held = entries.join(stored(mixed, "open-groups"), "key")
    in_major = (F.col("root") == F.col("major")) & (F.col("of_major") > 0)
    hashed = F.xxhash64("node")
    mine = F.when(in_major, F.pmod(hashed, F.col("of_major"))).otherwise(F.col("of_major") + F.pmod(hashed, F.col("of_rest"))).cast("int")
    others = F.sequence(F.when(in_major, F.col("of_major")).otherwise(0), F.col("of_major") + F.col("of_rest") - 1)
    spread = held.select("key", "node", "root", mine.alias("mine"), F.explode(others).alias("other"))
    return spread.select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("right"), "node", "root"
    )


def _by_group(rows: DataFrame, schema: str, one: Callable) -> DataFrame:
    """``one`` (key, i, j, right, node, root, values) -> record batches, for each group of ``rows``, one at a time.

    ``rows`` is (key, i, j, right, node, root, value, ...); values arrive as lists of Python objects. Groups of a
    partition are sorted and follow each other; a group may span batches.
    """

    def run(batches):
        import numpy as np

        def done(key, parts):
            right, node, root = (np.concatenate([p[k] for p in parts]) for k in range(3))
            values = [[x for p in parts for x in p[3 + k]] for k in range(len(parts[0]) - 3)]
            return one(*key, right, node, root, *values)

        open_key, parts = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5)]
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                key = tuple(keys[a].tolist())
                if key != open_key and parts:
                    yield from done(open_key, parts)
                    parts = []
                open_key = key
                parts.append((*[c[a:b] for c in columns], *[batch.column(c).slice(a, b - a).to_pylist() for c in range(6, batch.num_columns)]))
        if parts:
            yield from done(open_key, parts)

    order = ["key", "i", "j", "node"]
    return rows.repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(run, schema)


def _partners(right, root, sketches, alike: Callable):
    """Index pairs of a chunk pair with different roots and like sketches, in blocks of rows."""
    import numpy as np

    matrix = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    left = np.flatnonzero(~right)
    within = not right.any()
    others = left if within else np.flatnonzero(right)
    step = max(1, (1 << 22) // max(1, len(others) * matrix.shape[1]))
    for s in range(0, len(left), step):
        a = left[s : s + step]
        hit = alike(matrix[a][:, None, :], matrix[others][None, :, :]) & (root[a][:, None] != root[others][None, :])
        if within:
            hit &= a[:, None] < others[None, :]
        x, y = np.nonzero(hit)
        if len(x):
            yield a[x], others[y]


def _suspects(groups: DataFrame, alike: Callable) -> DataFrame:
    """The rows of ``groups`` that have a partner of another root with a like sketch."""

    def one(key, i, j, right, node, root, sketches):
        import numpy as np
        import pyarrow as pa

        found = np.zeros(len(node), bool)
        for x, y in _partners(right, root, sketches, alike):
            found[x] = found[y] = True
        at = np.flatnonzero(found)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), key)), pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), j, np.int32)),
                    pa.array(right[at]), pa.array(node[at]), pa.array(root[at]), pa.array([sketches[k] for k in at.tolist()], pa.binary()),
                ],
                names=["key", "i", "j", "right", "node", "root", "sketch"],
            )

    return _by_group(groups, "key long, i int, j int, right boolean, node long, root long, sketch binary", one)


def _forests(suspects: DataFrame, alike: Callable, percent: float) -> DataFrame:
    """(x, y): links of each group by the whole sets, as many as join what its links join.

    A pair that meets in several groups is held against its sets in the one of the smallest key alone; ``keys``
    are all groups of a node among the suspects.
    """

    def one(key, i, j, right, node, root, sketches, sets, keys):
        import numpy as np
        import pyarrow as pa

        values, groups = [np.frombuffer(x, np.uint64) for x in sets], [frozenset(x) for x in keys]
        names = {r: k for k, r in enumerate(dict.fromkeys(root.tolist()))}
        place, parent = [names[r] for r in root.tolist()], list(range(len(names)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for xs, ys in _partners(right, root, sketches, alike):
            for x, y in zip(xs.tolist(), ys.tolist()):
                p, q = find(place[x]), find(place[y])
                if p != q and min(groups[x] & groups[y]) == key and near(values[x], values[y], percent):
                    parent[q] = p
                    out.append((int(node[x]), int(node[y])))
        if out:
            pairs = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    return _by_group(suspects, "x long, y long", one)


def cross_links(entries: DataFrame, nodes: DataFrame, roots: DataFrame, sets: Callable, alike: Callable, percent: float) -> DataFrame:
    """Written (x, y): links between nodes of different roots that meet in a group, enough to join what they join.

    ``entries`` is (key, node), ``nodes`` (node, weight, sketch), ``roots`` (node, root); ``sets`` gives (node, set)
    for a table of nodes. ``alike`` compares arrays of sketches along their last axis.
    """
    placed = entries.select("key", "node").join(roots.join(nodes.select("node", "weight"), "node"), "node")
    groups = _chunk_pairs(stored(placed, "rooted-entries")).join(nodes.select("node", "sketch"), "node")
    columns = ["key", "i", "j", "right", "node", "root"]
    found = stored(_suspects(groups.select(*columns, "sketch"), alike), "suspects")
    wanted = stored(found.groupBy("node").agg(F.collect_set("key").alias("keys")), "wanted")
    whole = sets(wanted.select("node")).join(wanted, "node")
    return stored(_forests(found.join(whole, "node").select(*columns, "sketch", "set", "keys"), alike, percent).distinct(), "cross-links")
