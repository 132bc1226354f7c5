"""Reading capture payloads from JSON files, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.operators.capture import parse_payloads, to_posts, validate
from postsignal.operators.rows import exploded


def read_payload_documents(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of whole-file JSON documents: ``{"posts": [...]}``, one object, or a list.

    The document stays text until each payload is cut out as a variant, so unknown fields and the
    JSON type of every value survive. One document is one row: use JSON lines for bulk data.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return payload_items(whole, "value", "file")


def payload_items(documents: DataFrame, text: str, *ids: str) -> DataFrame:
    """Payloads within each JSON document text: (ids, ordinal, payload)."""
    docs = documents.select(*ids, F.try_parse_json(text).alias("doc"))
    kind = F.schema_of_variant("doc")
    posts = F.try_variant_get("doc", "$.posts", "array<variant>")
    items = (
        F.when(kind.startswith("ARRAY"), F.col("doc").try_cast("array<variant>"))
        .when(posts.isNotNull(), posts)
        .otherwise(F.array("doc"))
    )
    rows = exploded(docs.filter(F.col("doc").isNotNull()), items, "item", *ids, position="ordinal")
    return rows.select(*ids, "ordinal", F.to_json("item").alias("payload"))


def load_captures(spark: SparkSession, path: str) -> DataFrame:
    """Parsed captures of JSON documents, in document order (file, ordinal)."""
    return parse_payloads(read_payload_documents(spark, path))


def load_posts(spark: SparkSession, path: str, source: str = "manual_json") -> DataFrame:
    """Validated posts of JSON documents (column ``errors`` is empty for valid ones)."""
    return validate(to_posts(load_captures(spark, path), source))


def stream_payload_lines(spark: SparkSession, folder: str, max_files_per_trigger: int = 1_000) -> DataFrame:
    """Stream of JSON-lines payload files: (payload, captured_at)."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(folder)
    received = F.try_to_timestamp(F.get_json_object("value", "$.received_at"))
    return lines.filter(F.length("value") > 0).select(
        F.col("value").alias("payload"), F.coalesce(received, F.current_timestamp()).alias("captured_at")
    )
