"""Which stored media objects to delete under a byte quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsignal.operators.ordered import range_chunks, with_running_sum
from postsignal.policies import LifecyclePolicy, RetentionPolicy
from postsignal.runtime import materialize


def retention_plan(objects: DataFrame, now: int, policy: RetentionPolicy) -> DataFrame:
    """Objects to delete, with the reason and the bytes freed before each.

    ``objects``: sha, byte_size, reference_count, storage_policy, last_accessed, expires_at.
    Expired objects go first and always; then unreferenced, unprotected objects in order of
    last access (ties by digest) until the total is within the target. Walking the list until
    the target is met equals the condition ``total - freed before > target`` per row, which needs
    only a running sum.
    """
    sized = objects.filter(F.coalesce("byte_size", F.lit(0)) > 0)
    total = sized.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("t")).scalar()
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    free = (F.coalesce("reference_count", F.lit(0)) == 0) & ~F.coalesce("storage_policy", F.lit("")).isin(
        *policy.protected
    )
    candidates = (
        sized.withColumn("expired", expired)
        .filter(F.col("expired") | free)
        .select(
            "sha", "byte_size", "expired",
            F.when(F.col("expired"), 0).otherwise(1).alias("_class"),
            F.coalesce("last_accessed", F.lit(0)).alias("last_accessed"),
        )
    )
    ordered = with_running_sum(candidates, "byte_size", "freed_before", ["_class", "last_accessed", "sha"])
    over = (total - F.col("freed_before")) > policy.target_bytes
    return ordered.filter(F.col("expired") | over).select(
        "sha", "byte_size", "last_accessed", "freed_before",
        F.when(F.col("expired"), "retention_expired").otherwise("quota_unreferenced").alias("reason"),
    )


def expiry(stored_at: Column, ttl_seconds: Column) -> Column:
    """When an object expires: its time to live after it was stored; never without one."""
    return F.when(ttl_seconds.isNotNull(), stored_at + F.greatest(ttl_seconds, F.lit(0)))


def retained_objects(objects: DataFrame, plan: DataFrame, now: int) -> DataFrame:
    """The object table after a retention plan is carried out.

    A deleted object keeps its metadata as long as something refers to it: it is then
    ``metadata_only``, empty, with time and reason of the deletion. Without references its row goes.
    """
    gone = F.col("_reason").isNotNull()
    joined = objects.join(plan.select("sha", F.col("reason").alias("_reason")), "sha", "left")
    left = joined.filter(~gone | (F.coalesce("reference_count", F.lit(0)) > 0))
    return left.select(
        *[c for c in objects.columns if c != "byte_size"],
        F.when(gone, 0).otherwise(F.col("byte_size")).alias("byte_size"),
        F.when(gone, "metadata_only").otherwise("available").alias("availability"),
        F.col("_reason").alias("deleted_reason"),
        F.when(gone, F.lit(now)).cast("long").alias("deleted_at"),
    )


def retention_totals(objects: DataFrame, plan: DataFrame, policy: RetentionPolicy) -> DataFrame:
    """One-row account of a retention plan."""
    sized = objects.filter(F.coalesce("byte_size", F.lit(0)) > 0)
    is_expired = F.col("reason") == "retention_expired"
    freed = plan.agg(
        F.struct(
            F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"),
            F.count(F.lit(1)).alias("files"),
            F.count_if(is_expired).alias("expired"),
        ).alias("f")
    ).scalar()
    totals = sized.agg(
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes_before"),
        F.count_if(F.coalesce("storage_policy", F.lit("")).isin(*policy.protected)).alias("protected_files"),
        F.count(F.lit(1)).alias("remaining_files"),
    ).withColumn("_f", freed)
    return totals.select(
        "total_bytes_before",
        (F.col("total_bytes_before") - F.col("_f.bytes")).alias("total_bytes_after"),
        F.col("_f.bytes").alias("freed_bytes"),
        F.col("_f.files").alias("deleted_files"),
        F.col("_f.expired").alias("expired_files"),
        (F.col("_f.files") - F.col("_f.expired")).alias("quota_files"),
        "protected_files",
        "remaining_files",
        F.lit(policy.target_bytes).cast("long").alias("target_bytes"),
    )


def lifecycle_plan(objects: DataFrame, now: int, policy: LifecyclePolicy) -> DataFrame:
    """(object_id, data_class, byte_size, reason) of what goes: three budgets, one inside the other.

    ``objects``: object_id, data_class, byte_size, stored_at, last_accessed, pinned. Pinned objects stay and
    count. First goes what is older than its class allows (class_expired). Then each class with a budget gives
    up its least recently used objects until it fits (class_budget). If all that is left still fills more than
    the high mark of the disk, the least recently used of any class go until it is at the low mark
    (disk_watermark). Ties go by id; objects without bytes or class limits are kept; null access counts as never.

    Both running sums are over one division of the objects into ranges of last access: offsets are one row
    for each range and class, and no class is a window of its own.
    """
    spark = objects.sparkSession
    limits = spark.createDataFrame(
        [(c.name, c.max_age, c.max_bytes) for c in policy.classes], "data_class string, max_age long, max_bytes long"
    )
    size = F.greatest(F.coalesce(F.col("byte_size"), F.lit(0)), F.lit(0)).cast("long")
    rows = objects.select(
        "object_id", "data_class", size.alias("byte_size"), F.coalesce("pinned", F.lit(False)).alias("pinned"), "stored_at",
        F.coalesce("last_accessed", F.lit(-(1 << 62))).alias("used"),
    ).join(F.broadcast(limits), "data_class", "left")  # a row per class of the policy
    expired = ~F.col("pinned") & F.coalesce(F.col("stored_at") + F.col("max_age") <= now, F.lit(False))
    order = ("used", "object_id")
    marked = rows.withColumn("expired", expired).withColumn("free", F.when(F.col("pinned") | F.col("expired"), 0).otherwise(F.col("byte_size")))
    chunked = materialize(range_chunks(marked, [], order, rows=objects.count()))
    held = F.when(~F.col("expired"), F.col("byte_size")).otherwise(0)
    totals = materialize(chunked.groupBy("data_class").agg(F.sum(held).alias("class_total")))
    before = lambda *keys: Window.partitionBy(*(keys or [F.lit(0)])).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *keys: Window.partitionBy("chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = chunked.groupBy("data_class", "chunk").agg(F.sum("free").alias("n"))
    offsets = sums.select("data_class", "chunk", F.coalesce(F.sum("n").over(before("data_class")), none).alias("offset"))
    local = chunked.withColumn("freed", F.coalesce(F.sum("free").over(inside("data_class")), none))
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("data_class", "chunk")]
    joined = local.alias("a").join(offsets.alias("b"), key[0] & key[1]).select("a.*", "offset")
    joined = joined.alias("a").join(totals.alias("b"), key[0]).select("a.*", "offset", "class_total")
    over = F.coalesce(F.col("class_total") - F.col("freed") - F.col("offset") > F.col("max_bytes"), F.lit(False))
    chosen = materialize(joined.withColumn("budget", over & (F.col("free") > 0)).withColumn("left", F.when(F.col("budget"), 0).otherwise(F.col("free"))).drop("freed", "offset"))
    kept = chosen.agg(F.coalesce(F.sum(F.when(F.col("expired") | F.col("budget"), 0).otherwise(F.col("byte_size"))), F.lit(0)).alias("t")).first()["t"]
    target = policy.low_bytes if kept > policy.high_bytes else kept
    sums = chosen.groupBy("chunk").agg(F.sum("left").alias("n"))
    offsets = sums.select("chunk", F.coalesce(F.sum("n").over(before()), none).alias("offset"))
    local = chosen.withColumn("freed", F.coalesce(F.sum("left").over(inside()), none)).join(offsets, "chunk")
    disk = (F.col("left") > 0) & (F.lit(kept) - F.col("freed") - F.col("offset") > F.lit(target))
    reason = F.when(F.col("expired"), "class_expired").when(F.col("budget"), "class_budget").when(disk, "disk_watermark")
    return local.select("object_id", "data_class", "byte_size", reason.alias("reason")).filter("reason is not null")
