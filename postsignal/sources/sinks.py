"""Writing captures, audit rows and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.functions.ids import stable_id
from postsignal.operators.capture import correlation_id, redacted_payload
from postsignal.operators.rows import exploded


def audit_rows(rows: DataFrame, action: str, entity_type: str, entity_id: str, details: Column, at: str) -> DataFrame:
    """Audit entry of every row; ``details`` is a struct and is stored as JSON."""
    text = F.to_json(details, {"ignoreNullFields": "false"})
    return rows.select(
        stable_id(F.lit(action), F.col(entity_id), text, length=32).alias("audit_id"),
        F.lit(action).alias("action"),
        F.lit(entity_type).alias("entity_type"),
        F.col(entity_id).alias("entity_id"),
        text.alias("details_json"),
        F.col(at).alias("created_at"),
    )


def capture_tables(posts: DataFrame) -> dict[str, DataFrame]:
    """The four tables a set of accepted, deduplicated posts is stored as.

    A ``payload`` column is stored as ``raw_payload`` with the values of sensitive keys replaced. Posts that have
    ``raw_payload`` and ``correlation_id`` already keep them.
    """
    if "raw_payload" not in posts.columns:
        raw = F.col("payload") if "payload" in posts.columns else F.lit(None).cast("string")
        digest = F.col("idempotency_key")
        posts = posts.withColumn("correlation_id", correlation_id(raw, digest)).withColumn("raw_payload", redacted_payload(raw)).drop("payload")
    items = exploded(
        posts.withColumn("created_at", F.col("captured_at")), F.col("media"), "_m", "post_id", "created_at", position="position"
    )
    media = items.select(
        stable_id(F.col("post_id"), F.col("position"), F.col("_m.source_url"), length=32).alias("asset_id"),
        "post_id", "position", "_m.kind", "_m.source_url", "_m.alt_text", "_m.local_path",
        F.lit("metadata").alias("storage_policy"), F.lit("remote").alias("availability"), "created_at",
    )
    inbox = posts.select(
        stable_id(F.lit("inbox"), F.col("post_id"), length=32).alias("inbox_id"),
        "post_id",
        F.col("idempotency_key").alias("raw_payload_hash"),
        F.lit("accepted").alias("status"),
        "correlation_id",
        F.col("captured_at").alias("received_at"),
    )
    audit = audit_rows(
        posts, "capture.accepted", "captured_post", "post_id",
        F.struct(
            "capture_source", F.col("idempotency_key").alias("raw_payload_hash"), F.col("raw_payload").isNotNull().alias("raw_payload_present")
        ),
        "captured_at",
    )
    stored = posts.drop("correlation_id").withColumn("data_class", F.lit("visible_content")).withColumn("schema_version", F.lit(1))
    return {"captured_posts": stored, "media_assets": media, "capture_inbox": inbox, "audit_log": audit}


def write_batch(tables: dict[str, DataFrame], folder: str, batch_id: int) -> None:
    """Write each table's rows of one batch to its own partition.

    Writing the same batch again replaces the partition, so a retried micro-batch leaves no
    duplicate rows.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def read_table(spark: SparkSession, folder: str, name: str, before_batch: int | None = None) -> DataFrame | None:
    """A stored table (all batches, or those before one); None while nothing is stored."""
    path = f"{folder}/{name}"
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return None
    stored = spark.read.parquet(path)
    return stored if before_batch is None else stored.filter(F.col("batch_id") < before_batch)


def write_results(results: DataFrame, path: str) -> None:
    """Search results as JSON lines: id, url, content, summary, translated."""
    results.select("id", "url", "content", "summary", "translated").write.mode("overwrite").json(path)


def latest_version(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table (of those before a number); None while there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{folder}/{name}/version={max(numbers)}") if numbers else None


def replace_table(rows: DataFrame, folder: str, name: str, version: int) -> str:
    """Store a merged table under a new version folder and return its path.

    There is no in-place update: readers keep the old version until they switch. One writer.
    """
    path = f"{folder}/{name}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    return path
