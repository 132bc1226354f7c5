"""Posts about the same event: time-windowed clusters over shared keys, and how fast they grow.

Posts are linked where they share a key (entity, topic, quoted address, author ...) and lie in the same
session of that key: a run of posts in which neighbours are at most ``gap`` apart. What links reach is a
cluster, so one key forms many clusters over time, and a post with several keys joins their sessions. The
graph has an edge from each post to the first of its session, not between all posts of a session.

Sessions are found on range chunks: within a chunk by a running maximum, across chunks from one carried row
per key and chunk. A key that most posts share is spread over the cluster like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.operators.fingerprints import components
from postsignal.operators.ordered import range_chunks
from postsignal.operators.rows import exploded, join_keyed
from postsignal.runtime import materialize


def keyed_posts(posts: DataFrame, item: str, keys: Column, at: Column, *keep: str) -> DataFrame:
    """(item, key, start, end): one row per post and distinct key; posts without keys have none."""
    narrow = posts.select(F.col(item).alias("item"), at.alias("start"), F.array_distinct(keys).alias("_keys"), *keep)
    rows = exploded(narrow, F.col("_keys"), "key", "item", "start", *keep)
    return rows.filter(F.col("start").isNotNull()).withColumn("end", F.col("start"))


def with_sessions(spans: DataFrame, gap: int, keys: Sequence[str] = ("key",), tie: str = "item") -> DataFrame:
    """Add ``session``, the start of the session of each span (keys, start, end).

    A session is a longest run of spans of a key in which each starts at most ``gap`` after everything
    before it has ended. ``tie`` orders spans that start together, for a total order.
    """
    order = ("start", "end", tie)
    # bounds of the chunks must be the same for rows and carried values: fix them first
    chunked = materialize(range_chunks(spans, keys, order, rows=spans.count()))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each key and chunk: the latest end of all earlier chunks
    ends = chunked.groupBy(*keys, "chunk").agg(F.max("end").alias("_end")).select(*keys, "chunk", F.max("_end").over(earlier).alias("_carried"))
    local = chunked.withColumn("_seen", F.max("end").over(before)).join(ends, [*keys, "chunk"])
    seen = F.greatest("_seen", "_carried")  # the greater one that is not null
    marked = local.withColumn("_opens", F.when(seen.isNull() | (F.col("start") > seen + gap), F.col("start"))).drop("_seen", "_carried")
    marked = materialize(marked)
    opened = marked.groupBy(*keys, "chunk").agg(F.max("_opens").alias("_last")).select(*keys, "chunk", F.max("_last").over(earlier).alias("_open"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("_mine", F.max("_opens").over(upto)).join(opened, [*keys, "chunk"])
    return placed.withColumn("session", F.coalesce("_mine", "_open")).drop("_opens", "_mine", "_open", "chunk")


def session_links(placed: DataFrame, node: str = "item") -> DataFrame:
    """(a, b): every node of a session with its smallest node."""
    heads = materialize(placed.groupBy("key", "session").agg(F.min(node).alias("b"), F.count(F.lit(1)).alias("n")))
    return join_keyed(placed.select("key", "session", F.col(node).alias("a")), heads, ["key", "session"]).select("a", "b").filter("a <> b")


def event_clusters(posts: DataFrame, item: str, keys: Column, at: Column, gap: int) -> DataFrame:
    """(item, cluster_id) of every post: the smallest item of its cluster.

    ``keys`` is an array, ``at`` and ``gap`` are in the same unit. Posts without keys or time stand alone.
    """
    placed = materialize(with_sessions(keyed_posts(posts, item, keys, at), gap))
    roots = components(session_links(placed))
    return posts.select(item).join(roots.withColumnRenamed("node", item), item, "left").select(item, F.coalesce("root", item).alias("cluster_id"))


def cluster_facts(members: DataFrame, source: str, at: str, hour: int = 3600) -> DataFrame:
    """One row per cluster of ``members`` (cluster_id, source, at): size, sources, span, velocity and peak.

    ``velocity`` is posts per hour over the span, at least an hour; ``peak`` the most posts of a clock hour;
    ``acceleration`` the posts of the second half of the span less those of the first, over all. Everything
    is counted in combinable sums, first by (cluster, source, clock hour), so a huge cluster is many rows, and
    the posts of a huge cluster get its span where they are.
    """
    members = materialize(members.select("cluster_id", source, at))
    span = members.groupBy("cluster_id").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))
    span = materialize(span)
    late = (F.col(at) * 2 > F.col("first_at") + F.col("last_at")).cast("long")
    early = (F.col(at) * 2 < F.col("first_at") + F.col("last_at")).cast("long")
    cells = join_keyed(members, span, ["cluster_id"]).groupBy("cluster_id", source, F.floor(F.col(at) / hour).alias("_hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(late - early).alias("turn"), F.first("first_at").alias("first_at"), F.first("last_at").alias("last_at")
    )
    cells = materialize(cells)
    peaks = cells.groupBy("cluster_id", "_hour").agg(F.sum("n").alias("n")).groupBy("cluster_id").agg(F.max("n").alias("peak"))
    sources = cells.groupBy("cluster_id", source).agg(F.sum("n").alias("n"), F.sum("turn").alias("turn"), F.first("first_at").alias("first_at"), F.first("last_at").alias("last_at"))
    whole = sources.groupBy("cluster_id").agg(
        F.sum("n").alias("posts"), F.count(source).alias("sources"), F.first("first_at").alias("first_at"), F.first("last_at").alias("last_at"), F.sum("turn").alias("turn")
    )
    hours = F.greatest((F.col("last_at") - F.col("first_at")) / hour, F.lit(1.0))
    return whole.join(peaks, "cluster_id").select(
        "cluster_id", "posts", "sources", "first_at", "last_at", (F.col("posts") / hours).alias("velocity"), "peak", (F.col("turn") / F.col("posts")).alias("acceleration")
    )
