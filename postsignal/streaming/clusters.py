"""Event clusters kept up to date by a stream of posts; the same clusters as the batch form.

Three tables below a folder: ``cluster_sessions``, for each batch the sessions of its own keys with a post
that names their cluster, in buckets of keys; ``cluster_members``, the posts of each batch with the cluster
they joined; ``cluster_merges``, names of clusters that a batch has found to be one. A batch reads the
sessions of its own keys and writes them anew; other keys are not touched, and names that later merges
make stale stay valid, as all of them meet when the clusters are read.

A late post may close the gap between two sessions: both are spans of time, so the batch form's own step
joins them. Nothing is dropped for its age, and repeating a batch writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsignal.operators.event_clusters import keyed_posts, session_links, with_sessions
from postsignal.operators.fingerprints import components
from postsignal.operators.rows import join_keyed
from postsignal.runtime import materialize
from postsignal.sources.sinks import read_table, write_batch
from postsignal.streaming.capture import KEY_BUCKETS


def _sessions(points: DataFrame, folder: str, batch_id: int) -> DataFrame | None:
    """(item, key, start, end): the stored sessions of the keys of ``points``, named by their cluster."""
    stored = read_table(points.sparkSession, folder, "cluster_sessions", before_batch=batch_id)
    if stored is None:
        return None
    keys = materialize(points.select("key", _bucket("key").alias("bucket")).distinct())
    buckets = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most KEY_BUCKETS numbers
    known = stored.filter(F.col("bucket").isin(buckets)).join(keys.select("key"), "key", "left_semi")
    # the last batch that a key was in holds all of its sessions
    last = known.groupBy("key").agg(F.max("batch_id").alias("batch_id"))
    return known.join(materialize(last), ["key", "batch_id"]).select(F.col("cluster_id").alias("item"), "key", "start", "end")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def store_posts(posts: DataFrame, batch_id: int, folder: str, item: str, keys: Column, at: Column, gap: int, keep: tuple[str, ...] = ()) -> None:
    """Micro-batch step: merge the posts of a batch into the stored sessions and clusters."""
    fresh = materialize(posts.select(F.col(item).alias("item"), at.alias("at"), keys.alias("_keys"), *keep))
    if fresh.isEmpty():
        return
    points = materialize(keyed_posts(fresh, "item", F.col("_keys"), F.col("at")))
    before = _sessions(points, folder, batch_id)
    before = None if before is None else materialize(before)
    placed = materialize(with_sessions(points if before is None else points.unionByName(before), gap))
    roots = materialize(components(session_links(placed)))
    named = lambda rows: rows.join(roots.withColumnRenamed("node", "item"), "item", "left").withColumn("cluster_id", F.coalesce("root", "item")).drop("root")
    sessions = named(placed).groupBy("key", F.col("session").alias("start")).agg(F.max("end").alias("end"), F.min("cluster_id").alias("cluster_id"))
    merges = roots.limit(0) if before is None else before.select(F.col("item").alias("node")).distinct().join(roots, "node").filter("node <> root")
    write_batch({"cluster_members": named(fresh.drop("_keys")), "cluster_merges": merges}, folder, batch_id)
    rows = sessions.withColumn("bucket", _bucket("key")).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/cluster_sessions/batch_id={batch_id}")


def start_clusters(posts: DataFrame, folder: str, checkpoint: str, item: str, keys: Column, at: Column, gap: int, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """Run the stream of ``posts`` into the tables of ``folder``."""
    writer = posts.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda df, batch: store_posts(df, batch, folder, item, keys, at, gap, keep)).trigger(availableNow=True).start()


def read_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """(item, at, kept columns, cluster_id) of all posts stored so far, with joined clusters resolved."""
    members = read_table(spark, folder, "cluster_members")
    merges = read_table(spark, folder, "cluster_merges")
    roots = components(merges.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cluster_id")
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    names = materialize(roots.join(sizes, "cluster_id"))
    return join_keyed(members.drop("batch_id"), names, ["cluster_id"], how="left").withColumn("cluster_id", F.coalesce("root", "cluster_id")).drop("root")
