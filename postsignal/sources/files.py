"""Digests and paths of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SHA-256 and size of every file: (path, byte_size, exact_sha256)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return content_digests(reader.load(path), "path", "content")


def content_digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, byte_size, exact_sha256) of a column of bytes or text; null content has neither."""
    size, digest = F.octet_length(content).cast("long"), F.sha2(F.col(content).cast("binary"), 256)
    return rows.select(key, size.alias("byte_size"), digest.alias("exact_sha256"))


def content_path(digest, name):
    """Relative path of a stored object: two digest folders, then digest plus suffix."""
    suffix = F.lower(F.regexp_extract(name, r"[^/.](\.[^/.]+)$", 1))
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, suffix)
