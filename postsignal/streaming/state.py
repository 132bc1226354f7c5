"""Keyed state on streams: online weights and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from postsignal.operators.learning import take_tokens
from postsignal.policies import RetryPolicy, ThrottlePolicy, WeightPolicy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State of transformWithState lives in RocksDB; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def store_weights(rewarded: DataFrame, batch_id: int, folder: str, policy: WeightPolicy = WeightPolicy()) -> None:
    """Micro-batch step: the weights after a batch of rewards, as a new version of the table.

    The rewards of the batch are folded to one function per key first (``folded_weights``), in
    parallel even for a single key, and only then applied to the weights of the version before.
    Repeating a batch writes the same version. Rewards are applied in (ts, event_id) order inside a
    batch, batches in the order they arrive.
    """
    from postsignal.operators.learning import folded_weights
    from postsignal.sources.sinks import latest_version, replace_table

    before = latest_version(rewarded.sparkSession, folder, "weights", before=batch_id)
    seeds = None if before is None else before.select("key", F.col("value").alias("seed"))
    folded = folded_weights(rewarded, start=seeds, policy=policy)
    if before is not None:
        old = before.select("key", F.col("value").alias("_value"), F.col("steps").alias("_steps"))
        folded = folded.join(old, "key", "full").select(
            "key", F.coalesce("value", "_value").alias("value"), (F.coalesce("steps", F.lit(0)) + F.coalesce("_steps", F.lit(0))).alias("steps")
        )
    replace_table(folded, folder, "weights", batch_id)


def start_weights(rewarded: DataFrame, folder: str, checkpoint: str, policy: WeightPolicy = WeightPolicy()) -> StreamingQuery:
    """Keep the table ``weights`` of ``folder`` up to date with a stream of rewards."""
    writer = rewarded.select("key", "ts", "event_id", "reward").writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda df, batch: store_weights(df, batch, folder, policy)).trigger(availableNow=True).start()


class TokenBucket(StatefulProcessor):
    """Token bucket per key."""

    def __init__(self, policy: ThrottlePolicy, id_type: T.DataType):
        self.policy, self.id_type = policy, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, last = self.bucket.get() if self.bucket.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        flags, tokens, last = take_tokens(batch["at_us"].tolist(), tokens, last, self.policy)
        if tokens is not None:
            self.bucket.update((float(tokens), int(last)))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"].to_numpy(), "admitted": flags})

    def close(self) -> None:
        pass


def throttled(events: DataFrame, policy: ThrottlePolicy = ThrottlePolicy()) -> DataFrame:
    """Stream of (key, event_id, admitted) from events (key string, at_us long, event_id)."""
    id_type = events.schema["event_id"].dataType
    return (
        events.select("key", "at_us", "event_id")
        .groupBy("key")
        .transformWithStateInPandas(
            TokenBucket(policy, id_type),
            f"key string, event_id {id_type.simpleString()}, admitted boolean",
            "Append",
            "None",
        )
    )


def store_failures(failures: DataFrame, batch_id: int, folder: str, policy: RetryPolicy = RetryPolicy()) -> None:
    """Micro-batch step: routed failures to the ``retry`` and ``dead`` tables of the folder."""
    from postsignal.operators.backlog import route_failures
    from postsignal.sources.sinks import write_batch

    routed = route_failures(failures, policy)
    write_batch(
        {
            "retry": routed.filter("outcome = 'retry'"),
            "dead": routed.filter("outcome = 'dead'").drop("delay_cap_s"),
        },
        folder,
        batch_id,
    )
