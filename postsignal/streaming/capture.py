"""Capture stream: gate, validate, deduplicate, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsignal.functions.ids import outbox_key, stable_id
from postsignal.operators.capture import (
    correlation_id,
    parse_payloads,
    payload_too_large,
    redacted_payload,
    to_posts,
    validate,
)
from postsignal.operators.dedup import first_captures
from postsignal.policies import CapturePolicy
from postsignal.runtime import remove_folder, scratch_folder
from postsignal.sources.sinks import capture_tables, read_table, write_batch

#: Folders that the stored keys are dealt to.
KEY_BUCKETS = 64


def split_oversized(payloads: DataFrame, policy: CapturePolicy = CapturePolicy()) -> tuple[DataFrame, DataFrame]:
    """(payloads within the size limit, quarantine rows of those beyond)."""
    big = payload_too_large(F.col("payload"), policy)
    over = payloads.filter(big).withColumn("errors", F.array(F.lit("payload_too_large")))
    return payloads.filter(~big), quarantined(over)


def quarantined(rows: DataFrame) -> DataFrame:
    """Rejected payloads as they may be stored: values of sensitive keys replaced.

    A text that is no JSON cannot be searched for keys; of it only the digest is kept.
    """
    raw = F.col("payload")
    return rows.select(
        redacted_payload(raw).alias("payload"),
        F.sha2(raw, 256).alias("payload_sha"),
        correlation_id(raw, F.sha2(raw, 256)).alias("correlation_id"),
        "captured_at",
        "errors",
    )


def validated_posts(
    payloads: DataFrame, source: str = "extension", policy: CapturePolicy = CapturePolicy(), json_col: str = "payload"
) -> DataFrame:
    """Payloads as validated posts with a deterministic post id."""
    posts = validate(to_posts(parse_payloads(payloads, json_col), source, policy), policy)
    return posts.withColumn(
        "post_id", stable_id(F.col("idempotency_key"), F.col("captured_at"), length=32)
    )


def staged_posts(payloads: DataFrame, policy: CapturePolicy = CapturePolicy()) -> DataFrame:
    """Validated posts as they may be stored, rejected and oversized payloads among them with their ``errors``.

    In place of the payload stand ``raw_payload``, with the values of sensitive keys replaced, the ``payload_sha`` of
    rejected ones and the ``correlation_id``. An oversized payload is not parsed.
    """
    raw = F.col("payload")
    marked = payloads.filter(raw.isNotNull()).withColumn("_fitting", F.when(~payload_too_large(raw, policy), raw))
    posts = validated_posts(marked, policy=policy, json_col="_fitting").withColumn(
        "errors", F.when(F.col("_fitting").isNull(), F.array(F.lit("payload_too_large"))).otherwise(F.col("errors"))
    )
    posts = posts.withColumn("payload_sha", F.when(F.size("errors") > 0, F.sha2(raw, 256)))
    posts = posts.withColumn("correlation_id", correlation_id(raw, F.coalesce("payload_sha", "idempotency_key")))
    return posts.withColumn("raw_payload", redacted_payload(raw)).drop("payload", "_fitting")


def drop_repeats(payloads: DataFrame) -> DataFrame:
    """Drop payloads a client sent again, however late (works on streams and batches).

    On a stream every key seen is state: the key decides, not the age of the payload. Long-running
    streams look keys up in the stored ones instead (``store_batch``).
    """
    parsed = parse_payloads(payloads)
    keyed = parsed.withColumn(
        "outbox_key",
        outbox_key(F.col("url"), F.col("author_handle"), F.col("text"), F.try_element_at("media", F.lit(1))["source_url"]),
    ).select(*payloads.columns, "outbox_key")
    if not payloads.isStreaming:
        from postsignal.operators.dedup import first_per_key

        return first_per_key(keyed, ["outbox_key"], ["captured_at", "payload"]).drop("outbox_key")
    return keyed.dropDuplicates(["outbox_key"]).drop("outbox_key")


def _keys(posts: DataFrame) -> DataFrame:
    """The keys of captures, one row per kind of key, with the bucket they are stored in."""
    pid = F.nullif(F.col("platform_post_id"), F.lit(""))
    kinds = F.array(F.concat(F.lit("k:"), "idempotency_key"), F.concat(F.lit("p:"), "platform", F.lit("|"), pid))
    rows = posts.select("post_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("key"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).cast("int"))


def _known(fresh: DataFrame, folder: str, batch_id: int) -> DataFrame | None:
    """(post_id) of captures one of whose keys is stored; only the buckets of their own keys are read."""
    spark = fresh.sparkSession
    stored = read_table(spark, folder, "captured_keys", before_batch=batch_id)
    if stored is None:
        return None
    arrived = _keys(fresh)
    buckets = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # at most KEY_BUCKETS numbers
    known = stored.filter(F.col("bucket").isin(buckets)).select("key")
    return arrived.join(known, "key", "left_semi").select("post_id").distinct()


def store_batch(payloads: DataFrame, batch_id: int, folder: str, policy: CapturePolicy = CapturePolicy()) -> None:
    """Store one micro-batch: four tables for new captures, a quarantine for the rest.

    Repeating a batch writes the same partitions with the same rows: ids are derived, and the
    look-up of stored captures sees only earlier batches. The batch is parsed and redacted once, into a scratch
    table that goes with the batch; what is new in it is a second one. Each stored table reads its own columns of these, and a task reads a
    split of a file, however large the batch is.
    """
    spark = payloads.sparkSession
    scratch = scratch_folder(spark, "capture-batch")

    def staged(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{scratch}/{name}")

    try:
        posts = staged(staged_posts(payloads, policy), "posts")
        if posts.isEmpty():  # batches without data only move the watermark
            return
        valid = posts.filter(F.size("errors") == 0).drop("errors", "payload_sha")
        fresh = staged(first_captures(valid), "fresh")
        known = _known(fresh, folder, batch_id)
        if known is not None:
            fresh = fresh.join(staged(known, "known"), "post_id", "left_anti")
        tables = capture_tables(fresh)
        tables["quarantine"] = posts.filter(F.size("errors") > 0).select(
            F.col("raw_payload").alias("payload"), "payload_sha", "correlation_id", "captured_at", "errors"
        )
        write_batch(tables, folder, batch_id)
        # last, so that a batch that is repeated after a failure still finds its captures new
        keys = _keys(fresh).select("key", "bucket").repartition("bucket")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/captured_keys/batch_id={batch_id}")
    finally:
        remove_folder(spark.sparkContext, scratch)


def start_capture(
    payloads: DataFrame, folder: str, checkpoint: str, policy: CapturePolicy = CapturePolicy(), available_now: bool = True,
) -> StreamingQuery:
    """Run the capture stream into ``folder``. At-least-once input gives each capture once.

    There is no watermark: a capture that arrives late is stored like any other, unless one of its
    keys is stored already.
    """
    writer = (
        payloads.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: store_batch(df, batch_id, folder, policy))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
