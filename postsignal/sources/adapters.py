"""Views that give general-purpose tables the shape the operators expect.

Each view is a projection of one table (or an equi-join of two), so scans keep column pruning
and pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsignal.operators.fingerprints import simhash
from postsignal.functions.text import words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores when its files are too few for that.

    Text work is CPU-bound, and a small table may be a single row group, which is one task. A
    table of at least as many splits as cores is read as it is, without any shuffle.
    """
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    splits = rows.rdd.getNumPartitions() if cores > 1 else cores
    return rows if splits >= cores else rows.repartition(cores)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1_000) -> DataFrame:
    """The same table as a file stream, at most ``files_per_trigger`` files in a micro-batch.

    A table is usually a folder of part files. A file stream must name a folder, so a table that is
    one file is picked out of the folder around it.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_per_trigger)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if location.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(location).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts with zero to two attachments."""
    docs = text_table(spark, folder, "documents")
    n = F.col("doc_id") % 3
    alt = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("image of "), F.col("source"))).otherwise("")
    items = F.transform(
        F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))),
        lambda i: F.struct(
            F.concat(F.lit("m"), i.cast("string")).alias("id"),
            F.when(F.col("doc_id") % 5 == 0, "video").otherwise("image").alias("media_type"),
            F.concat(F.lit("https://media.example/"), F.col("doc_id"), F.lit("/"), i.cast("string")).alias("source_url"),
            alt.alias("alt_text"),
            F.lit("").alias("ocr_text"),
            F.lit("unknown").alias("copyright_status"),
        ),
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("source").alias("author_handle"),
        "text",
        "lang",
        F.lit("").alias("quoted_text"),
        F.when(n == 0, F.slice(items, 1, 0)).otherwise(items).alias("media"),
        F.col("doc_id").alias("ordinal"),
        F.col("n_chars").alias("followers_count"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://x.com/q/"), F.col("doc_id"))).alias("quoted_url"),
    )


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw capture payloads (JSON text), using every alias and some broken fields."""
    return as_payloads(text_table(spark, folder, "documents"))


def as_payloads(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    handle = F.concat(F.lit("@"), F.initcap("source"))
    url = F.concat(
        F.when(d % 17 == 0, "https://example.com/").when(d % 3 == 0, "https://twitter.com/").otherwise("https://x.com/"),
        F.col("source"), F.lit("/status/"), d, F.when(d % 2 == 0, "?s=20&t=p").otherwise("#top"),
    )
    base = F.concat(F.lit("https://img.example/"), d)
    avatar = F.struct(
        F.lit("image").alias("type"), F.concat(base, F.lit("/profile_images/a.jpg")).alias("url"),
        F.lit("picture of author").alias("alt_text"), F.lit("avatar").alias("media_scope"),
    )
    picture = F.struct(
        F.when(d % 4 == 0, "photo").otherwise("image").alias("type"), F.concat(base, F.lit("/p.jpg?w=1")).alias("url"),
        F.concat(F.lit("shown in "), F.col("lang")).alias("alt_text"), F.lit("post").alias("media_scope"),
    )
    payload = F.struct(
        F.when(d % 2 == 0, F.col("text")).alias("text"),
        F.when(d % 2 == 1, F.col("text")).alias("content"),
        F.when(d % 2 == 0, url).alias("url"),
        F.when(d % 2 == 1, url).alias("post_url"),
        F.when((d % 13 != 0) & (d % 2 == 0), handle).alias("author_handle"),
        F.when((d % 13 != 0) & (d % 2 == 1), handle).alias("handle"),
        F.when(d % 5 != 0, F.floor(d / 2).cast("string")).alias("id"),
        F.concat(F.lit("2024-01-"), F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.when(d % 7 == 0, "T99").otherwise("T09:30:00Z")).alias("timestamp"),
        F.when(d % 3 == 0, F.concat(F.lit("quoting "), F.col("source"))).alias("quoted_text"),
        F.lit("@Quoted").alias("quoted_author"),
        F.create_map(
            F.concat(F.col("n_chars"), F.lit(" Likes")), F.format_number("n_chars", 0),
            F.lit("views"), F.concat((d % 9).cast("string"), F.lit(".2K")),
        ).alias("visible_metrics"),
        F.when(d % 4 != 3, F.array(avatar, picture)).alias("media"),
        F.lit("visible_dom_v1").alias("raw_capture_version"),
        F.lit("Bearer x").alias("authorization"),
        F.struct(F.lit("private").alias("csrf_token"), F.col("lang").alias("lang")).alias("nested"),
    )
    return docs.select(
        d.cast("string").alias("post_id"),
        F.timestamp_seconds(F.lit(1704067200) + d).alias("captured_at"),
        F.to_json(payload).alias("payload"),
    )


def quoted_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with the turn before as quoted text."""
    from postsignal.operators.lookups import with_previous_text

    return with_previous_text(table(spark, folder, "conversations"))


def media_objects(spark: SparkSession, folder: str) -> DataFrame:
    """References to stored media: every document is a stored blob of its text."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.sha2("text", 256).alias("sha"),
        F.col("n_chars").alias("byte_size"),
        F.col("doc_id").cast("string").alias("reference_id"),
        F.when(F.col("source") == "src0", "original").otherwise("thumbnail").alias("storage_policy"),
        F.col("doc_id").alias("last_accessed"),
        (F.col("doc_id") % 2 == 1).alias("referenced"),
        F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).alias("expires_at"),
    )


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """60-bit SimHash of every document."""
    docs = text_table(spark, folder, "documents").select("doc_id", "text")
    hashed = simhash(docs, "doc_id", words(F.lower("text")))
    return hashed.select(F.col("doc_id").alias("item"), F.lit("simhash60-v1").alias("algorithm"), "bits")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewer feedback derived from the event log."""
    return as_feedback(table(spark, folder, "events"))


def as_feedback(e: DataFrame) -> DataFrame:
    actions = {
        "purchase": "posted_manually", "signup": "approved", "click": "edited", "view": "ignored", "error": "rejected",
    }
    action = None
    for kind, name in actions.items():
        cond = F.col("event_type") == kind
        action = F.when(cond, name) if action is None else action.when(cond, name)
    variant = (
        F.when(F.col("user_id") % 4 == 0, "reaction")
        .when(F.col("user_id") % 4 == 1, "dry_humor")
        .when(F.col("user_id") % 4 == 2, "neutral_short")
        .otherwise("quote_context")
    )
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("suggestion_id"),
        action.alias("action"), variant.alias("variant_label"),
    )


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions that feedback refers to; those of users who never purchased are missing."""
    bought = feedback(spark, folder).filter("action = 'posted_manually'")
    return bought.select("suggestion_id", "variant_label").distinct()


def observations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "source", (F.col("quality") * 100.0).alias("observed"), F.col("doc_id").alias("ordinal")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as work items."""
    return as_jobs(table(spark, folder, "orders"))


def as_jobs(o: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "retry").otherwise("dead")
    priority = F.lit(None).cast("int")
    for digit, value in (("1", 100), ("2", 90), ("3", 70), ("4", 40), ("5", 20)):
        priority = F.when(F.substring("o_orderpriority", 1, 1) == digit, value).otherwise(priority)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "light").when(F.col("o_orderkey") % 3 == 1, "heavy").otherwise("io")
    created = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("payload_ref"), status.alias("status"),
        priority.alias("priority"), kind.alias("resource_class"), created.alias("created_us"),
        created.alias("available_us"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("attempt"),
    )


def search_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
